"""The layers as stored tables: raw, staging, facts, marts.

Each staged table, each fact table and each mart that another table reads is written once to the shared folder
and read back, as a scheduled rebuild of the layers would do. The order of the work follows from
which tables a mart asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martloom.config import MartConfig
from martloom.operators.sequence import parts
from martloom.operators.storage import shared_dir
from martloom.plans import common, staging
from martloom.sources.raw import save_buckets, save_table


class Warehouse:
    def __init__(
        self, spark: SparkSession, raw: dict[str, DataFrame], cfg: MartConfig,
        folder: str | None = None,
    ) -> None:
        self.spark, self.raw, self.cfg = spark, raw, cfg
        self.folder = folder or f"{shared_dir(spark)}/martloom-{uuid.uuid4().hex}"
        self.regions = raw["regions"] if "regions" in raw else staging.default_regions(spark)
        self._stored: dict[str, DataFrame] = {}
        self._remembered: dict[str, object] = {}

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Writes a table on its first use and reads it from storage from then on."""
        if name not in self._stored:
            self._stored[name] = save_table(build(), f"{self.folder}/{name}")
        return self._stored[name]

    def remember(self, name: str, build: Callable[[], object]) -> object:
        """A result that is built once but is not a table, such as a fitted model."""
        if name not in self._remembered:
            self._remembered[name] = build()
        return self._remembered[name]

    def order_rows(self) -> int:
        """Rows of the largest raw table that is dealt by order; sizes the partitions of them all."""
        return self.remember("order_rows", lambda: max(
            self.raw[name].count() for name in ("orders", "order_items", "payments")))

    # --- staging -------------------------------------------------------------------------

    def staging_plan(self, name: str) -> DataFrame:
        """The staging query of one table; its parent orders are read from storage."""
        raw = self.raw
        plans: dict[str, Callable[[], DataFrame]] = {
            "customers": lambda: staging.stg_customers(raw["customers"], self.regions),
            "sellers": lambda: staging.stg_sellers(raw["sellers"], self.regions),
            "products": lambda: staging.stg_products(raw["products"], raw["category_translation"]),
            "geolocation": lambda: staging.stg_geolocation(
                raw["geolocation"], raw["postal_directory"], self.regions
            ),
            "orders": lambda: staging.stg_orders(raw["orders"], self.cfg, rows=self.order_rows()),
            "order_items": lambda: staging.stg_order_items(
                raw["order_items"], self.stg("orders"), self.order_rows()
            ),
            "payments": lambda: staging.stg_payments(
                raw["payments"], self.stg("orders"), self.order_rows()
            ),
            "reviews": lambda: staging.stg_reviews(raw["reviews"], self.stg("orders")),
        }
        return plans[name]()

    def stg(self, name: str) -> DataFrame:
        """The stored staging table. Tables dealt by order are stored in buckets of order, unless
        they are too small for more partitions than there are cores."""
        key = f"stg_{name}"
        if key not in self._stored and name in ("orders", "order_items", "payments"):
            n = parts(self.spark, self.order_rows())
            if n > self.spark.sparkContext.defaultParallelism:
                self._stored[key] = save_buckets(
                    self.staging_plan(name), f"{self.folder}/{key}", "order_id", n)
        return self.keep(key, lambda: self.staging_plan(name))

    # --- customer key --------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self._people()[0]

    def orders(self) -> DataFrame:
        return self._people()[1]

    def _people(self) -> tuple[DataFrame, DataFrame]:
        """Customers and orders under the configured customer key."""
        customers, orders = self.stg("customers"), self.stg("orders")
        if self.cfg.customer_key == "customer_id":
            return customers, orders
        if "people" not in self._stored:
            people, keyed = staging.by_person(customers, orders)
            self.keep("people", lambda: people)
            self.keep("keyed_orders", lambda: keyed)
        return self._stored["people"], self._stored["keyed_orders"]

    # --- facts ---------------------------------------------------------------------------

    def facts(self, name: str) -> DataFrame:
        """Order, item or payment facts, keyed by the configured customer."""
        plans: dict[str, Callable[[], DataFrame]] = {
            "orders": lambda: common.order_facts(
                self.orders(), self.stg("payments"), self.stg("reviews"), self.stg("order_items"),
                self.order_rows(),
            ),
            "items": lambda: common.item_facts(
                self.stg("order_items"), self.orders(), self.stg("products")
            ),
            "payments": lambda: common.payment_facts(self.stg("payments"), self.orders()),
        }
        return self.keep(f"fact_{name}", plans[name])

    # --- marts ---------------------------------------------------------------------------

    def mart_plan(self, name: str) -> DataFrame:
        """The mart's query over stored tables."""
        from martloom.plans.catalog import MARTS

        return MARTS[name](self)

    def mart(self, name: str) -> DataFrame:
        """The stored mart."""
        return self.keep(f"mart_{name}", lambda: self.mart_plan(name))
