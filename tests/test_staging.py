import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.config import MartConfig
from martloom.plans import staging
from martloom.plans.warehouse import Warehouse
from martloom.sources.raw import RAW_SCHEMAS

CFG = MartConfig(as_of=dt.date(2018, 9, 1))


def raw(spark, name, rows):
    return spark.createDataFrame(rows, RAW_SCHEMAS[name])


def ts(day, hour=0):
    return None if day is None else dt.datetime(2018, 1, 1, hour) + dt.timedelta(days=day)


def order(oid, *days, status=" Delivered ", customer="c1"):
    return (oid, customer, status, *[ts(d) for d in days])


def test_orders_sequence_check(spark):
    rows = [
        order("all", 0, 1, 2, 3, 9), order("equal", 1, 1, 1, 1, 9), order("no_approval", 0, None, 2, 3, 9),
        order("no_carrier", 0, 1, None, 3, 9), order("not_delivered", 0, 1, 2, None, 9, status="invoiced"),
        order("approved_early", 2, 1, 3, 4, 9), order("carrier_early", 0, 3, 2, 4, 9),
        order("carrier_before_purchase", 2, None, 1, 4, 9), order("delivered_early", 0, 1, 4, 3, 9),
        order("future", 400, 401, 402, 403, 410), order("no_purchase", None, 1, 2, 3, 9),
    ]
    got = {r.order_id: r for r in staging.stg_orders(raw(spark, "orders", rows), CFG).collect()}
    assert set(got) == {"all", "equal", "no_approval", "no_carrier", "not_delivered"}
    assert got["all"].order_status == "delivered" and got["all"].is_delivered and got["all"].is_completed
    assert not got["not_delivered"].is_delivered and got["not_delivered"].is_completed


def test_orders_keep_the_earliest_duplicate(spark):
    rows = [order("o", 5, 6, 7, 8, 9), order("o", 0, 1, 2, 3, 9)]
    got = staging.stg_orders(raw(spark, "orders", rows), CFG).collect()
    assert [r.order_purchase_timestamp for r in got] == [ts(0)]


def test_unknown_customers_only_checked_on_request(spark):
    orders = raw(spark, "orders", [order("o", 0, 1, 2, 3, 9, customer="x")])
    customers = spark.createDataFrame([("c1",)], "customer_id string")
    assert staging.stg_orders(orders, CFG).count() == 1
    assert staging.stg_orders(orders, CFG, customers).count() == 0


def test_customers_are_normalised_and_filtered(spark):
    rows = [("a", "u1", 1037, "sao paulo", " sp "), ("b", "u1", 999, "x", "SP"), ("c", "u2", 20000, "x", "ZZ"),
            ("d", None, 20000, "x", "RJ"), ("a", "u0", 1037, "campinas", "SP")]
    got = staging.stg_customers(raw(spark, "customers", rows), staging.default_regions(spark)).collect()
    assert [(r.customer_id, r.customer_unique_id, r.customer_city, r.customer_state, r.customer_region,
             r.customer_zip_code_prefix) for r in got] == [("a", "u0", "Campinas", "SP", "Sudeste", "1037")]


def test_every_state_has_a_region(spark):
    regions = {r.state: r.region for r in staging.default_regions(spark).collect()}
    assert len(regions) == 27 and set(regions.values()) == {"Norte", "Nordeste", "Centro-Oeste", "Sudeste", "Sul"}


def test_products_null_bad_sizes_and_keep_the_best_row(spark):
    rows = [("p", "Cama ", 1, 1, 1, None, 10.0, 10.0, 10.0), ("p", "Cama ", 1, 1, 2, 500.0, 10.0, 301.0, 0.0),
            ("p", "cama", 1, 1, 5, 700.0, 10.0, 10.0, 10.0), ("q", None, 1, 1, 1, 100001.0, 1.0, 1.0, 1.0)]
    names = spark.createDataFrame([("CAMA", "Bed "), ("cama", "bed")], RAW_SCHEMAS["category_translation"])
    got = {r.product_id: r for r in staging.stg_products(raw(spark, "products", rows), names).collect()}
    assert got["p"].product_weight_g == 700.0 and got["p"].product_category_name_english == "bed"
    assert got["q"].product_weight_g is None and got["q"].product_category_name_english == "unknown"
    assert got["q"].product_category_name == "unknown"


@pytest.fixture()
def orders(spark):
    return spark.createDataFrame([("o1",), ("o2",)], "order_id string")


def test_items_need_a_parent_and_valid_prices(spark, orders):
    rows = [("o1", 1, "p", "s", ts(3), 10.0, 1.0), ("o1", 1, "p", "s", ts(1), 20.0, 1.0),
            ("o1", 2, "p", "s", ts(1), 50000.0, 0.0), ("o1", 3, "p", "s", ts(1), 50000.01, 0.0),
            ("o1", 4, "p", "s", ts(1), -1.0, 0.0), ("o1", 5, None, "s", ts(1), 1.0, 0.0),
            ("gone", 1, "p", "s", ts(1), 1.0, 0.0)]
    got = {(r.order_item_id, r.price, r.total_item_value)
           for r in staging.stg_order_items(raw(spark, "order_items", rows), orders).collect()}
    assert got == {(1, 20.0, 21.0), (2, 50000.0, 50000.0)}


def test_payments_domain(spark, orders):
    rows = [("o1", 1, " Credit_Card ", None, 10.0), ("o1", 1, "boleto", 1, 30.0), ("o1", 2, "bitcoin", 1, 5.0),
            ("o1", 3, "voucher", 0, 5.0), ("o1", 4, "voucher", 1, 0.0), ("gone", 1, "voucher", 1, 5.0),
            ("o2", 1, "credit_card", None, 7.0)]
    got = {(r.order_id, r.payment_type, r.payment_installments, r.payment_value, r.is_credit_card, r.is_boleto)
           for r in staging.stg_payments(raw(spark, "payments", rows), orders).collect()}
    assert got == {("o1", "boleto", 1, 30.0, False, True), ("o2", "credit_card", 1, 7.0, True, False)}


def test_reviews_keep_the_latest(spark, orders):
    rows = [("r", "o1", 5, None, " ", ts(1), None), ("r", "o1", 2, " t ", " late ", ts(4), None),
            ("s", "o1", 6, None, None, ts(1), None), ("t", "o1", 3, None, None, None, None),
            ("u", "o2", 1, None, "  ", ts(1), None)]
    got = {r.review_id: (r.review_score, r.review_comment_title, r.review_comment_message, r.has_comment)
           for r in staging.stg_reviews(raw(spark, "reviews", rows), orders).collect()}
    assert got == {"r": (2, "t", "late", True), "u": (1, None, "", False)}


def test_geolocation_prefers_the_directory(spark):
    seen = [(1037, -23.5, -46.6, "sao paulo", "sp"), (1037, -23.7, -46.8, "sao paulo", "SP"),
            (1037, -23.6, -46.7, "sao paulo", "SP"), (20000, 0.0, 0.0, "rio", "RJ"),
            (20000, -22.9, -43.2, "rio", "RJ"), (30000, 40.0, -43.0, "x", "MG"), (40000, -12.9, -38.5, "x", "ZZ")]
    directory = [("01037000", "São Paulo", "SP", "355", -46.65, -23.55), ("01037999", "Other", "RJ", "999", -46.0, -23.0),
                 ("20000000", "Rio", "RJ", "330", 10.0, 10.0)]
    geo = staging.stg_geolocation(raw(spark, "geolocation", seen), raw(spark, "postal_directory", directory),
                                  staging.default_regions(spark))
    got = {r.geolocation_zip_code_prefix: r for r in geo.collect()}
    assert set(got) == {"01037", "20000"}
    sp, rj = got["01037"], got["20000"]
    assert (sp.geolocation_city, sp.geolocation_lat, sp.municipality_id, sp.data_source) == (
        "São Paulo", -23.55, "355", "directory")
    assert (rj.geolocation_city, rj.geolocation_lat, rj.data_source, rj.geolocation_region) == (
        "Rio", -22.9, "observed", "Sudeste")
    shares = {r.data_source: r.pct for r in staging.geolocation_coverage(geo, "data_source").collect()}
    assert shares == {"directory": 50.0, "observed": 50.0}
    assert {r.geolocation_region for r in staging.geolocation_coverage(geo, "geolocation_region").collect()} == {"Sudeste"}
    assert staging.geolocation_validity(geo).first().pct_valid == 100.0


def test_people_own_the_orders_of_all_their_ids(spark):
    customers = raw(spark, "customers", [("c1", "u", 2000, "x", "SP"), ("c2", "u", 2000, "x", "SP"), ("c3", "v", 2000, "x", "SP")])
    orders = raw(spark, "orders", [order("o1", 0, 1, 2, 3, 9, customer="c1"), order("o2", 0, 1, 2, 3, 9, customer="c2"),
                                   order("o3", 0, 1, 2, 3, 9, customer="lost")])
    people, keyed = staging.by_person(customers, orders)
    assert {r.customer_id for r in people.collect()} == {"u", "v"}
    assert {(r.order_id, r.customer_id) for r in keyed.collect()} == {("o1", "u"), ("o2", "u"), ("o3", "lost")}


def test_warehouse_uses_the_person_key_by_default(spark):
    tables = {
        "customers": raw(spark, "customers", [("c1", "u", 2000, "x", "SP"), ("c2", "u", 2000, "x", "SP")]),
        "orders": raw(spark, "orders", [order("o1", 0, 1, 2, 3, 9, customer="c1"), order("o2", 40, 41, 42, 43, 50, customer="c2")]),
        "payments": raw(spark, "payments", [("o1", 1, "boleto", 1, 10.0), ("o2", 1, "boleto", 1, 20.0)]),
        "reviews": raw(spark, "reviews", []),
        "order_items": raw(spark, "order_items", []),
        "products": raw(spark, "products", []),
        "category_translation": raw(spark, "category_translation", []),
    }
    base = Warehouse(spark, tables, CFG).mart("customer_base").collect()
    assert [(r.customer_id, r.total_orders, r.total_revenue, r.is_repeat_customer) for r in base] == [("u", 2, 30.0, True)]
    by_order = Warehouse(spark, tables, MartConfig(as_of=CFG.as_of, customer_key="customer_id")).mart("customer_base")
    assert by_order.where(F.col("is_repeat_customer")).count() == 0 and by_order.count() == 2


def test_geolocation_medians_and_ties(spark):
    # Prefix 5: two cities in one state (the first city in order wins), an even number of points
    # (the lower median), and a point at (0, 0) that does not count.
    seen = [(5, -10.0, -50.0, "b town", "SP"), (5, -12.0, -52.0, "b town", "SP"), (5, -11.0, -51.0, "b town", "SP"),
            (5, -13.0, -53.0, "b town", "SP"), (5, 0.0, 0.0, "b town", "SP"), (5, -20.0, -60.0, "a  city", " sp "),
            (6, -5.0, -45.0, "x", "RJ"), (6, -5.0, -45.0, "x", "RJ"), (None, -5.0, -45.0, "y", "RJ")]
    geo = staging.stg_geolocation(raw(spark, "geolocation", seen), raw(spark, "postal_directory", []),
                                  staging.default_regions(spark))
    got = {r.geolocation_zip_code_prefix: (r.geolocation_city, r.geolocation_lat, r.geolocation_lng)
           for r in geo.collect()}
    assert got == {"00005": ("A  City", -20.0, -60.0), "00006": ("X", -5.0, -45.0)}
    b_town = staging.stg_geolocation(raw(spark, "geolocation", seen[:5]), raw(spark, "postal_directory", []),
                                     staging.default_regions(spark)).first()
    assert (b_town.geolocation_lat, b_town.geolocation_lng) == (-12.0, -52.0)


def test_geolocation_inputs_cover_every_case(layers):
    raw = layers.raw["geolocation"]
    per_prefix = raw.groupBy("geolocation_zip_code_prefix").count().agg(F.max("count")).first()[0]
    assert per_prefix >= 3
    assert raw.where("geolocation_lat = 0 and geolocation_lng = 0").count() > 0
    assert raw.where("geolocation_lat > 5").count() > 0
    assert raw.where("geolocation_zip_code_prefix is null").count() > 0
    sources = {r.data_source for r in layers.stg("geolocation").select("data_source").distinct().collect()}
    assert sources == {"directory", "observed"}
