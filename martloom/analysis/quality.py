"""Quality checks of the staged tables."""

from __future__ import annotations

from functools import partial

from martloom.analysis.common import ANALYSES
from martloom.operators.quality import fk_check, key_check, null_profile

PROFILED = {
    "customers": ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                  "customer_state", "customer_region"),
    "sellers": ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state", "seller_region"),
    "products": ("product_id", "product_category_name", "product_category_name_english",
                 "product_name_lenght", "product_description_lenght", "product_photos_qty",
                 "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"),
    "orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
                    "price", "freight_value"),
    "payments": ("order_id", "payment_sequential", "payment_type", "payment_installments",
                 "payment_value"),
    "reviews": ("review_id", "order_id", "review_score", "review_comment_title",
                "review_comment_message", "review_creation_date", "review_answer_timestamp"),
}

KEYS = {
    "customers": ["customer_id"], "sellers": ["seller_id"], "products": ["product_id"],
    "orders": ["order_id"], "order_items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"], "reviews": ["review_id"],
}


def profile(name, w):
    return null_profile(w.stg(name), f"stg_{name}", PROFILED[name])


def raw_keys(name, w):
    """Key check of a raw table, before deduplication."""
    return key_check(w.raw[name], KEYS[name], name)


for _name in PROFILED:
    ANALYSES[f"dq_nulls_{_name}"] = partial(profile, _name)
for _name in ("orders", "order_items", "payments"):
    ANALYSES[f"dq_raw_keys_{_name}"] = partial(raw_keys, _name)
ANALYSES["dq_orphan_items"] = lambda w: fk_check(
    w.raw["order_items"], w.stg("orders"), "order_id", "order_items.order_id")
ANALYSES["dq_orphan_customers"] = lambda w: fk_check(
    w.stg("orders"), w.stg("customers"), "customer_id", "orders.customer_id")
