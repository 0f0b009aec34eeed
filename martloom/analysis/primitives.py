"""Single operators on the raw and staged tables, so that each can be run and checked alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import (
    cents, day_diff, from_cents, initcap_words, lookup, money_sum, month_diff, month_start,
    norm_lower, norm_upper, pearson, ratio, rnd, season, week_start,
)
from martloom.functions.fixed import STATE_REGION, UNKNOWN_REGION
from martloom.operators.ranking import global_position, ntile_of, quantiles, value_profile
from martloom.operators.sequence import (
    distinct_count, keep_first, most_frequent, sequence_within, top_per_group,
)
from martloom.plans.customer import rfm_codes
from martloom.reports.common import grouped, rows, whole


def _table(w, name):
    return w.raw[name]


@analysis("prim_dedup")
def dedup(w):
    items = _table(w, "order_items")
    return keep_first(items, ["order_id", "order_item_id"], [
        F.col("shipping_limit_date").asc_nulls_first(), "product_id", "seller_id", "price", "freight_value"])


@analysis("prim_top_value")
def top_value(w):
    """Product of the dearest item of each seller."""
    return _table(w, "order_items").groupBy("seller_id").agg(
        F.max_by("product_id", F.struct("price", "product_id")).alias("product_id"))


@analysis("prim_mode")
def mode(w):
    return most_frequent(w.facts("payments"), "customer_id", "payment_type", "method")


@analysis("prim_distinct_count")
def distinct(w):
    return distinct_count(_table(w, "order_items"), "seller_id", "product_id", "products")


@analysis("prim_top_per_group")
def top_three(w):
    """Three largest orders of each customer."""
    value = w.stg("payments").groupBy("order_id").agg(money_sum("payment_value").alias("value"))
    owned = w.orders().select("order_id", "customer_id").join(value, "order_id")
    return top_per_group(owned, ["customer_id"], [F.desc("value"), "order_id"], 3)


def _order_values(w):
    return w.stg("payments").groupBy("order_id").agg(F.sum(cents("payment_value")).alias("value_c"))


@analysis("prim_positions")
def positions(w):
    """Row number, quintile and cumulative share of every order by value."""
    placed = global_position(_order_values(w), [F.col("value_c").desc(), F.col("order_id")])
    return placed.select("order_id", "position", ntile_of("position", "total_rows", 5).alias("quintile"),
                         rnd(F.col("position") * 100.0 / F.col("total_rows"), 6).alias("pct"))


@analysis("prim_value_ranks")
def value_ranks(w):
    """Dense rank, percent rank and running total (ties together) of payment values."""
    paid = w.stg("payments").select(cents("payment_value").alias("value_c"), cents("payment_value").alias("v"))
    profile = value_profile(paid, "value_c", sums=["v"])
    n = profile.agg(F.max("cum_n").alias("n")).scalar()
    return profile.select(
        from_cents("value_c").alias("payment_value"), F.col("n").alias("payments"), "dense_rank",
        rnd(ratio(F.col("cum_n") - F.col("n"), n - 1), 6).alias("percent_rank"),
        from_cents("cum_v").alias("running_total"))


@analysis("prim_quantiles")
def exact_quantiles(w):
    return quantiles(w.stg("payments"), "payment_value", [0.5, 0.75, 0.9, 0.99])


@analysis("prim_sequence")
def sequence(w):
    """Place of each order in its customer's history and the date before it."""
    ordered = sequence_within(
        w.orders().select("customer_id", "order_id", "order_purchase_timestamp"), "customer_id",
        ["order_purchase_timestamp", "order_id"], "order_purchase_timestamp")
    return ordered.select("customer_id", "order_id", "seq",
                          day_diff("order_purchase_timestamp", "previous_order_purchase_timestamp").alias("gap"))


@analysis("prim_correlation")
def correlation(w):
    return grouped(w.stg("order_items"), ["seller_id"],
                   price_freight=rnd(pearson("price", "freight_value"), 6), items=rows())


@analysis("prim_sequence_check")
def sequence_check(w):
    """Lines shipped before their order was placed."""
    early = day_diff("shipping_limit_date", "order_purchase_timestamp") < 0
    lines = _table(w, "order_items").select("order_id", "shipping_limit_date")
    return whole(lines.join(_table(w, "orders").select("order_id", "order_purchase_timestamp"), "order_id"),
                 lines=rows(), early_lines=F.count_if(early))


@analysis("prim_dates")
def dates(w):
    bought = F.col("order_purchase_timestamp")
    return _table(w, "orders").select(
        "order_id", week_start(bought).alias("week"), month_start(bought).alias("month"),
        F.date_format(bought, "yyyy-'Q'q").alias("quarter"), F.date_format(bought, "EEEE").alias("weekday"),
        F.dayofweek(bought).alias("day_number"), F.add_months(F.to_date(bought), -3).alias("three_months_back"),
        month_diff(w.cfg.today, bought).alias("months_ago"), season(F.month(bought)).alias("season"))


@analysis("prim_text")
def text(w):
    c = F.col("customer_city")
    return _table(w, "customers").select(
        "customer_id", initcap_words(c).alias("title"), norm_lower(c).alias("lower"),
        norm_upper(F.concat(F.lit("  "), c)).alias("upper"), F.substring(c, 1, 3).alias("prefix"),
        F.concat(c, F.lit(" → "), "customer_state").alias("route"))


@analysis("prim_numbers")
def numbers(w):
    p = F.col("price")
    return w.stg("order_items").select(
        "order_id", "order_item_id", rnd(F.log1p(p), 6).alias("log1p"), rnd(F.sqrt(p), 6).alias("sqrt"),
        rnd(F.sin(p), 6).alias("sin"), rnd(F.cos(p), 6).alias("cos"), rnd(F.pow(p, 2), 4).alias("pow2"),
        F.floor(p).alias("floor"), F.abs(F.col("freight_value") - p).alias("abs_gap"),
        F.greatest("price", "freight_value").alias("greatest"))


@analysis("prim_pivot")
def pivot(w):
    """Payments per installment count and type."""
    wide = w.stg("payments").groupBy("payment_installments").pivot(
        "payment_type", ["boleto", "credit_card", "debit_card", "voucher"]).agg(rows())
    return wide.na.fill(0)


@analysis("prim_crosstab")
def crosstab(w):
    """Row-normalised order status per month."""
    g = w.orders().groupBy(month_start("order_purchase_timestamp").alias("month")).pivot(
        "order_status", ["canceled", "delivered", "invoiced"]).agg(rows()).na.fill(0)
    n = F.col("canceled") + F.col("delivered") + F.col("invoiced")
    return g.select("month", *[rnd(F.col(c) / n, 6).alias(c) for c in ("canceled", "delivered", "invoiced")])


@analysis("prim_rolling")
def rolling(w):
    """Monthly orders with difference, three-month mean and running total."""
    g = grouped(w.orders(), [month_start("order_purchase_timestamp").alias("month")], orders=rows())
    line = Window.orderBy("month")  # one row per month
    return g.select("month", "orders", (F.col("orders") - F.lag("orders").over(line)).alias("change"),
                    rnd(F.avg("orders").over(line.rowsBetween(-2, 0)), 6).alias("mean_3"),
                    F.sum("orders").over(line).alias("so_far"))


@analysis("prim_lookup")
def lookups(w):
    """Map lookups with a default: RFM codes of a mart, regions of states outside the map."""
    return w.mart("customer_rfm").select(
        "customer_id", lookup("rfm_score", rfm_codes(), "Other").alias("segment"),
        lookup("customer_state", STATE_REGION, UNKNOWN_REGION).alias("region"))


@analysis("prim_night_share")
def night_share(w):
    """Share of events at night and at the weekend per user (needs times of day)."""
    hour = F.hour("ts")
    night = (hour >= 20) | (hour < 6)
    return grouped(w.raw["events"], ["user_id"], events=rows(),
                   pct_night=rnd(F.avg(night.cast("int")) * 100),
                   pct_weekend=rnd(F.avg(F.dayofweek("ts").isin(1, 7).cast("int")) * 100))
