"""Staging: raw tables to validated, deduplicated tables with one row per key.

Regions come from a (state, region) table; a state outside it is invalid, so the region join is
the state filter. The child tables are checked against the staged orders with a semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.functions import cents, from_cents, initcap_words, norm_lower, norm_upper, rate_where
from martloom.functions.fixed import (
    LATITUDE_RANGE,
    LONGITUDE_RANGE,
    PAYMENT_TYPES,
    STATE_REGION,
    UNKNOWN_REGION,
)
from martloom.operators.ranking import grouped_quantile, share_of_total
from martloom.operators.sequence import dealt, keep_first


def default_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_REGION.items()), "state string, region string")


def _asc(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def _located(raw: DataFrame, regions: DataFrame, kind: str) -> DataFrame:
    """City, state, region and postal prefix of customers or sellers."""
    zip_code = F.col(f"{kind}_zip_code_prefix")
    return (
        raw.where(zip_code.cast("string").try_cast("bigint").between(1000, 99999))
        .withColumn(f"{kind}_zip_code_prefix", zip_code.cast("string"))
        .withColumn(f"{kind}_city", F.trim(initcap_words(f"{kind}_city")))
        .withColumn(f"{kind}_state", norm_upper(f"{kind}_state"))
        .join(
            regions.select(F.col("state").alias(f"{kind}_state"), F.col("region").alias(f"{kind}_region")),
            f"{kind}_state",
        )
    )


def stg_customers(raw: DataFrame, regions: DataFrame) -> DataFrame:
    valid = raw.where(F.col("customer_id").isNotNull() & F.col("customer_unique_id").isNotNull())
    tidy = _located(valid, regions, "customer").select(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        "customer_state", "customer_region",
    )
    return keep_first(tidy, ["customer_id"], _asc(
        "customer_unique_id", "customer_state", "customer_city", "customer_zip_code_prefix"))


def stg_sellers(raw: DataFrame, regions: DataFrame) -> DataFrame:
    tidy = _located(raw.where(F.col("seller_id").isNotNull()), regions, "seller").select(
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "seller_region"
    )
    return keep_first(tidy, ["seller_id"], _asc("seller_state", "seller_city", "seller_zip_code_prefix"))


def _within(name: str, low: float, high: float) -> Column:
    """The value when low < value <= high, else NULL; the row stays."""
    c = F.col(name)
    return F.when((c > low) & (c <= high), c).alias(name)


def stg_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    names = keep_first(
        translation.select(
            norm_lower("product_category_name").alias("_key"),
            norm_lower("product_category_name_english").alias("_english"),
        ),
        ["_key"],
        _asc("_english"),
    )
    tidy = (
        raw.where(F.col("product_id").isNotNull())
        .withColumn("_key", norm_lower("product_category_name"))
        .join(names, "_key", "left")
        .select(
            "product_id",
            F.coalesce("_key", F.lit("unknown")).alias("product_category_name"),
            F.coalesce("_english", F.lit("unknown")).alias("product_category_name_english"),
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            _within("product_weight_g", 0, 100000),
            _within("product_length_cm", 0, 300),
            _within("product_height_cm", 0, 300),
            _within("product_width_cm", 0, 300),
        )
    )
    rest = _asc(*[c for c in tidy.columns if c not in ("product_id", "product_photos_qty")])
    return keep_first(
        tidy,
        ["product_id"],
        [F.col("product_weight_g").isNull(), F.col("product_photos_qty").desc_nulls_last(), *rest],
    )


def stg_geolocation(raw: DataFrame, directory: DataFrame, regions: DataFrame) -> DataFrame:
    """Median position per postal prefix; the official directory wins where it has the prefix."""

    def inside(lat: str, lon: str) -> Column:
        return F.col(lat).between(*LATITUDE_RANGE) & F.col(lon).between(*LONGITUDE_RANGE)

    states = regions.select(F.col("state").alias("_state"))
    points = (
        raw.where(F.col("geolocation_zip_code_prefix").isNotNull())
        .where(inside("geolocation_lat", "geolocation_lng"))
        .where(~((F.col("geolocation_lat") == 0) & (F.col("geolocation_lng") == 0)))
        .select(
            # Padded: a numeric prefix has lost its leading zero, the directory keeps it.
            F.lpad(F.col("geolocation_zip_code_prefix").cast("string"), 5, "0").alias("zip"),
            F.trim(initcap_words("geolocation_city")).alias("city"),
            norm_upper("geolocation_state").alias("_state"),
            "geolocation_lat",
            "geolocation_lng",
        )
        .join(states, "_state", "left_semi")
    )
    # Exact medians per (prefix, city, state): a prefix with millions of points is never one task.
    group = ["zip", "city", "_state"]
    lat = grouped_quantile(points, group, "geolocation_lat", 0.5, "lat")
    lng = grouped_quantile(points, group, "geolocation_lng", 0.5, "lng").select(
        *[F.col(k).alias(f"_{k}") for k in group], "lng")
    seen = lat.join(lng, [lat[k].eqNullSafe(lng[f"_{k}"]) for k in group]).select(*group, "lat", "lng")
    official = (
        directory.where(F.col("cep").isNotNull() & F.col("sigla_uf").isNotNull())
        .where(inside("lat", "lon"))
        .groupBy(F.substring("cep", 1, 5).alias("zip"))
        # One whole entry per prefix, so that city, state and position belong together.
        .agg(F.min(F.struct("cep", "localidade", "sigla_uf", "id_municipio", "lat", "lon")).alias("d"))
    )
    chosen = seen.join(official, "zip", "left").select(
        F.col("zip").alias("geolocation_zip_code_prefix"),
        F.coalesce("d.localidade", "city").alias("geolocation_city"),
        F.coalesce("d.sigla_uf", "_state").alias("geolocation_state"),
        F.coalesce("d.lat", "lat").alias("geolocation_lat"),
        F.coalesce("d.lon", "lng").alias("geolocation_lng"),
        F.col("d.id_municipio").alias("municipality_id"),
        F.when(F.col("d.localidade").isNotNull(), "directory").otherwise("observed").alias("data_source"),
    )
    with_region = chosen.join(
        regions.select(F.col("state").alias("geolocation_state"), F.col("region").alias("_region")),
        "geolocation_state",
        "left",
    ).withColumn("geolocation_region", F.coalesce("_region", F.lit(UNKNOWN_REGION))).drop("_region")
    columns = [
        "geolocation_zip_code_prefix", "geolocation_city", "geolocation_state", "geolocation_lat",
        "geolocation_lng", "municipality_id", "data_source", "geolocation_region",
    ]
    return keep_first(
        with_region.select(columns),
        ["geolocation_zip_code_prefix"],
        [F.col("data_source") != "directory", *_asc("geolocation_state", "geolocation_city",
                                                    "geolocation_lat", "geolocation_lng")],
    )


def geolocation_coverage(geo: DataFrame, by: str) -> DataFrame:
    """Prefixes and share per data source or per region."""
    counts = geo.groupBy(by).agg(F.count(F.lit(1)).alias("total_zips"))
    return counts.withColumn("pct", share_of_total("total_zips"))


def geolocation_validity(geo: DataFrame) -> DataFrame:
    valid = F.col("geolocation_lat").between(*LATITUDE_RANGE) & F.col("geolocation_lng").between(
        *LONGITUDE_RANGE
    )
    return geo.agg(
        F.count(F.lit(1)).alias("total_zips"),
        F.count_if(valid).alias("valid_zips"),
        rate_where(valid).alias("pct_valid"),
    )


def in_sequence() -> Column:
    """Purchase, approval, carrier and delivery in order; a missing step is skipped."""
    bought, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    carrier, arrived = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")

    def after(step: Column, *earlier: Column) -> Column:
        return step.isNull() | (step >= F.coalesce(*earlier))

    return (
        after(approved, bought) & after(carrier, approved, bought)
        & after(arrived, carrier, approved, bought)
    )


def _of_orders(tidy: DataFrame, orders: DataFrame, rows: int) -> DataFrame:
    """Rows of known orders, dealt by order: no task sorts a whole file split, and an order's rows
    stay together. The ids are joined as distinct rows, since the optimizer moves a semi join below
    the dealing, where a large table is shuffled and sorted once more."""
    ids = dealt(orders.select("order_id"), "order_id", rows).distinct()
    return dealt(tidy, "order_id", rows).join(ids, "order_id").select(tidy.columns)


def stg_orders(
    raw: DataFrame, cfg: MartConfig, customers: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Pass ``customers`` to also require a known customer (off by default). ``rows`` sizes the
    partitions (by default the rows of ``raw``), here and in the tables below orders."""
    status = norm_lower("order_status")
    tidy = (
        raw.where(F.col("order_id").isNotNull() & F.col("customer_id").isNotNull())
        .where(F.col("order_purchase_timestamp") <= cfg.now)
        .where(in_sequence())
        .select(
            "order_id", "customer_id", status.alias("order_status"), "order_purchase_timestamp",
            "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
            "order_estimated_delivery_date",
            (status == "delivered").alias("is_delivered"),
            status.isin("delivered", "invoiced").alias("is_completed"),
            (status == "canceled").alias("is_canceled"),
        )
    )
    if customers is not None:
        tidy = tidy.join(customers.select("customer_id"), "customer_id", "left_semi").select(tidy.columns)
    return keep_first(dealt(tidy, "order_id", rows or raw.count()), ["order_id"], _asc(
        "order_purchase_timestamp", "customer_id", "order_status", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date"))


def stg_order_items(raw: DataFrame, orders: DataFrame, rows: int | None = None) -> DataFrame:
    ids = ("order_id", "product_id", "seller_id")
    tidy = (
        raw.dropna(subset=list(ids))
        .where(F.col("price").between(0, 50000) & (F.col("freight_value") >= 0))
        .select(
            "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
            "freight_value",
        )
    )
    known = _of_orders(tidy, orders, rows or raw.count())
    first = keep_first(known, ["order_id", "order_item_id"], _asc(
        "shipping_limit_date", "product_id", "seller_id", "price", "freight_value"))
    return first.withColumn(
        "total_item_value", from_cents(cents("price") + cents("freight_value")))


def stg_payments(raw: DataFrame, orders: DataFrame, rows: int | None = None) -> DataFrame:
    kind = norm_lower("payment_type")
    installments = F.coalesce("payment_installments", F.lit(1))
    tidy = (
        raw.where(F.col("order_id").isNotNull() & (F.col("payment_value") > 0))
        .where((installments >= 1) & kind.isin(*PAYMENT_TYPES))
        .select(
            "order_id", "payment_sequential", kind.alias("payment_type"),
            installments.alias("payment_installments"), "payment_value",
        )
    )
    known = _of_orders(tidy, orders, rows or raw.count())
    return keep_first(
        known,
        ["order_id", "payment_sequential"],
        [F.col("payment_value").desc_nulls_last(), *_asc("payment_type", "payment_installments")],
    ).withColumns({
        "is_credit_card": F.col("payment_type") == "credit_card",
        "is_boleto": F.col("payment_type") == "boleto",
    })


def stg_reviews(raw: DataFrame, orders: DataFrame) -> DataFrame:
    message = F.trim("review_comment_message")
    tidy = (
        raw.where(F.col("review_id").isNotNull() & F.col("order_id").isNotNull())
        .where(F.col("review_score").between(1, 5) & F.col("review_creation_date").isNotNull())
        .select(
            "review_id", "order_id", "review_score",
            F.trim("review_comment_title").alias("review_comment_title"),
            message.alias("review_comment_message"),
            "review_creation_date", "review_answer_timestamp",
            F.coalesce(message != "", F.lit(False)).alias("has_comment"),
        )
        .join(orders.select("order_id"), "order_id", "left_semi")
        .select("review_id", "order_id", "review_score", "review_comment_title",
                "review_comment_message", "review_creation_date", "review_answer_timestamp",
                "has_comment")
    )
    return keep_first(
        dealt(tidy, "review_id", raw.count()),
        ["review_id"],
        [F.col("review_creation_date").desc_nulls_last(),
         *_asc("order_id", "review_score", "review_answer_timestamp", "review_comment_title",
               "review_comment_message")],
    )


def by_person(customers: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Use the person-level id as ``customer_id`` (the raw one is new for every order).

    Customers become one row per person; each order carries its person.
    """
    person = F.col("customer_unique_id")
    people = keep_first(customers, ["customer_unique_id"], _asc("customer_id"))
    owner = customers.select("customer_id", person.alias("_person"))
    keyed = orders.join(owner, "customer_id", "left").withColumn(
        "customer_id", F.coalesce("_person", "customer_id")
    )
    return people.withColumn("customer_id", person), keyed.select(orders.columns)
