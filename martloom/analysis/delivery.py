"""Delivery analysis: an order-level fact table, its cleaning and features, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import (
    bins, day_diff, from_cents, lookup, money_avg, pearson, rate_where, ratio, rnd,
)
from martloom.functions.fixed import REGION_ENGLISH
from martloom.operators.ranking import quantile_scalars, share_of_total
from martloom.reports.common import grouped, mean, rows, top, whole
from martloom.sources.raw import metric_rows

STATUS = [(0, "On Time"), (5, "Slight Delay"), (15, "Moderate Delay")]


@analysis("delivery_fact")
def fact(w) -> DataFrame:
    """Delivered orders with delivery days, SLA status, review, freight and region."""
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    freight, price = from_cents("freight_c"), from_cents("price_c")
    delay = day_diff(arrived, promised)
    return (
        w.facts("orders").where("order_status = 'delivered'").where(arrived.isNotNull() & promised.isNotNull())
        .join(w.customers().select("customer_id", "customer_state", "customer_city", "customer_region"),
              "customer_id", "left")
        .select(
            "order_id", "customer_id", "customer_state", "customer_city", "order_purchase_timestamp",
            "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
            "order_estimated_delivery_date",
            day_diff("order_delivered_carrier_date", "order_purchase_timestamp").alias("days_to_carrier"),
            day_diff(arrived, "order_delivered_carrier_date").alias("days_in_transit"),
            day_diff(arrived, "order_purchase_timestamp").alias("total_delivery_days"),
            delay.alias("delay_days"),
            (delay <= 0).cast("int").alias("sla_compliant"),
            bins(delay, STATUS, "Severe Delay").alias("delivery_status"),
            "review_score", "review_comment_message",
            freight.alias("freight_value"), price.alias("item_price"),
            ratio(freight, price).alias("freight_to_price_ratio"),
            # English names for the default geography; other region names stay as they are.
            F.coalesce(lookup("customer_region", REGION_ENGLISH), "customer_region", F.lit("Other"))
            .alias("region"),
        )
    )


def clean_rules():
    """Name -> rows kept by that cut."""
    return {
        "delivery_days": F.col("total_delivery_days").between(1, 100),
        "freight": (F.col("freight_value") > 0) & (F.col("freight_value") <= 200),
        "early": F.col("delay_days") >= -30,
        "sequence": F.col("order_delivered_customer_date") >= F.col("order_purchase_timestamp"),
    }


def _filled(w) -> DataFrame:
    """The fact table with missing reviews and freight set to their medians."""
    raw = w.keep("delivery_fact", lambda: fact(w))
    (review,), (freight,) = (quantile_scalars(raw, c, [0.5]) for c in ("review_score", "freight_value"))
    return raw.withColumn("review_score", F.coalesce(F.col("review_score").cast("double"), review)
                          ).withColumn("freight_value", F.coalesce("freight_value", freight))


def cleaned(w) -> DataFrame:
    """Stored once: every summary below reads it."""
    def build():
        out = _filled(w)
        for keep in clean_rules().values():
            out = out.where(keep)
        return out

    return w.keep("delivery_clean", build)


@analysis("delivery_cleaning")
def cleaning(w) -> DataFrame:
    """Rows before and after, and what each cut removes from the rows the earlier ones kept."""
    kept, counts = F.lit(True), {"initial_rows": rows()}
    for name, keep in clean_rules().items():
        counts[f"removed_by_{name}"] = F.count_if(kept & ~F.coalesce(keep, F.lit(False)))
        kept = kept & F.coalesce(keep, F.lit(False))
    row = whole(_filled(w), **counts, final_rows=F.count_if(kept))
    return row.withColumn("retention_pct", rnd(ratio("final_rows", "initial_rows") * 100, 4))


@analysis("delivery_features")
def features(w) -> DataFrame:
    df = cleaned(w)
    (q3,) = quantile_scalars(df, "freight_value", [0.75])
    bought, freight = F.col("order_purchase_timestamp"), F.col("freight_value")
    return df.select(
        "order_id", "customer_state", "region", "total_delivery_days", "delay_days", "sla_compliant",
        "delivery_status", "freight_value", "item_price", "review_score",
        bins("delay_days", STATUS, "Severe Delay").alias("delay_category"),
        F.date_format(bought, "EEEE").alias("purchase_weekday"),
        F.month(bought).alias("purchase_month"),
        F.date_format(bought, "yyyy-MM").alias("purchase_year_month"),
        ratio(freight, "total_delivery_days").alias("freight_per_day"),
        (freight > q3).cast("int").alias("high_freight"),
        bins(freight, [(10, "Low"), (20, "Medium"), (40, "High")], "Very High").alias("freight_category"),
        (F.col("review_score") >= 4).cast("int").alias("positive_review"),
        (F.col("review_score") <= 2).cast("int").alias("negative_review"),
    )


def _late():
    return F.col("delay_days") > 0


@analysis("delivery_kpis")
def kpis(w):
    return whole(cleaned(w), total_orders=rows(), sla_rate=mean("sla_compliant", 6),
                 avg_delivery_days=mean("total_delivery_days", 6),
                 avg_delay_when_late=mean(F.when(_late(), F.col("delay_days")), 6),
                 delayed_orders=F.count_if(_late()), delayed_pct=rate_where(_late(), 4),
                 avg_freight=money_avg("freight_value"), avg_review=mean("review_score", 6))


@analysis("delivery_sla_by_region")
def sla_by_region(w):
    return grouped(cleaned(w), ["region"], sla_compliant=mean("sla_compliant", 6)).orderBy(
        F.desc("sla_compliant"))


@analysis("delivery_sla_by_month")
def sla_by_month(w):
    month = F.month("order_purchase_timestamp").alias("purchase_month")
    return grouped(cleaned(w), [month], sla_compliant=mean("sla_compliant", 6)).orderBy("purchase_month")


@analysis("delivery_status_share")
def status_share(w):
    g = grouped(cleaned(w), ["delivery_status"], orders=rows())
    return g.withColumn("percentage", share_of_total("orders", 1))


@analysis("delivery_delay_stats")
def delay_stats(w):
    df = cleaned(w)
    (median,) = quantile_scalars(df, "delay_days", [0.5])
    return whole(df, mean=mean("delay_days", 6), std=rnd(F.stddev_samp("delay_days"), 6),
                 min=F.min("delay_days"), max=F.max("delay_days")).withColumn("median", median)


def _regional(w, digits):
    return grouped(cleaned(w), ["region"], total_orders=rows(),
                   avg_delivery_days=mean("total_delivery_days", digits),
                   avg_delay_days=mean("delay_days", digits), sla_rate=mean("sla_compliant", digits),
                   avg_freight=rnd(money_avg("freight_value"), digits),
                   avg_review_score=mean("review_score", digits))


@analysis("delivery_regions")
def regions(w):
    return _regional(w, 2)


@analysis("delivery_region_highlights")
def region_highlights(w):
    def first(by):
        return F.min_by("region", F.struct(by, "region"))

    return whole(_regional(w, 6), best_sla_region=first(-F.col("sla_rate")),
                 worst_sla_region=first(F.col("sla_rate")),
                 longest_delivery_region=first(-F.col("avg_delivery_days")))


@analysis("delivery_state_delay")
def state_delay(w):
    return grouped(cleaned(w), ["customer_state"], delay_days=mean("delay_days", 6))


@analysis("delivery_review_impact")
def review_impact(w):
    """Correlation of delay and review with its reading, and the fitted line."""
    df = cleaned(w)
    x, y = F.col("delay_days").cast("double"), F.col("review_score").cast("double")
    row = whole(df, correlation=rnd(pearson(x, y), 6), slope=rnd(F.regr_slope(y, x), 6),
                intercept=rnd(F.regr_intercept(y, x), 6), r_squared=rnd(F.regr_r2(y, x), 6))
    size = F.abs("correlation")
    strength = F.when(size > 0.3, "strong").when(size > 0.1, "moderate").otherwise("weak")
    return row.select(
        "*", strength.alias("strength"),
        F.when(F.col("correlation") < 0, "negative").otherwise("positive").alias("direction"),
        *[rnd(F.col("intercept") + F.col("slope") * d, 4).alias(f"predicted_at_{d}") for d in (0, 5, 10, 15)])


@analysis("delivery_review_by_status")
def review_by_status(w):
    return grouped(cleaned(w), ["delivery_status"], review_score=mean("review_score", 6),
                   negative_review_pct=rate_where(F.col("review_score") <= 2, 1)).orderBy(
        F.desc("review_score"))


@analysis("delivery_freight_by_status")
def freight_by_status(w):
    return grouped(cleaned(w), ["delivery_status"], avg_freight=rnd(money_avg("freight_value"), 6)).orderBy(
        F.desc("avg_freight"))


@analysis("delivery_sla_by_freight")
def sla_by_freight(w):
    return grouped(features(w), ["freight_category"], orders=rows(), sla_compliant=mean("sla_compliant", 6))


@analysis("delivery_freight_roi")
def freight_roi(w):
    """SLA and cost of dear against cheap freight."""
    high = F.col("high_freight") == 1
    sla, cost = F.col("sla_compliant"), F.col("freight_value")
    row = whole(features(w), freight_time_correlation=rnd(pearson("freight_value", "total_delivery_days"), 6),
                high_freight_sla=mean(F.when(high, sla), 6), low_freight_sla=mean(F.when(~high, sla), 6),
                high_freight_avg=rnd(money_avg(F.when(high, cost)), 6),
                low_freight_avg=rnd(money_avg(F.when(~high, cost)), 6))
    gain = F.col("high_freight_sla") - F.col("low_freight_sla")
    extra = F.col("high_freight_avg") - F.col("low_freight_avg")
    return row.withColumns({
        "sla_improvement": rnd(gain, 6), "cost_difference": rnd(extra, 6),
        "cost_per_sla_point": F.when(rnd(gain, 6) > 0, rnd(ratio(extra, gain * 100), 4))})


@analysis("delivery_quadrants")
def quadrants(w):
    """Orders by freight and SLA, each against its median."""
    df = cleaned(w)
    (cost,), (sla,) = (quantile_scalars(df, c, [0.5]) for c in ("freight_value", "sla_compliant"))
    side = F.concat(
        F.when(F.col("freight_value") > cost, "High Cost, ").otherwise("Low Cost, "),
        F.when(F.col("sla_compliant") > sla, "High Performance").otherwise("Low Performance"))
    g = grouped(df, [side.alias("quadrant")], orders=rows())
    return g.withColumn("pct", share_of_total("orders", 1))


def _states(w):
    return grouped(cleaned(w), ["customer_state"], total_orders=rows(), sla_compliant=mean("sla_compliant", 6),
                   delay_days=mean("delay_days", 6), total_delivery_days=mean("total_delivery_days", 6),
                   avg_freight=rnd(money_avg("freight_value"), 6))


@analysis("delivery_worst_sla_states")
def worst_sla_states(w):
    return top(_states(w), 10, "sla_compliant", "customer_state")


@analysis("delivery_worst_delay_states")
def worst_delay_states(w):
    return top(_states(w), 10, F.desc("delay_days"), "customer_state").select(
        "customer_state", "delay_days", "sla_compliant")


@analysis("delivery_by_month")
def by_month(w):
    return grouped(cleaned(w), [F.month("order_purchase_timestamp").alias("purchase_month")],
                   total_orders=rows(), sla_compliant=mean("sla_compliant", 6),
                   delay_days=mean("delay_days", 6), avg_freight=rnd(money_avg("freight_value"), 6)
                   ).orderBy("purchase_month")


@analysis("delivery_by_weekday")
def by_weekday(w):
    bought = F.col("order_purchase_timestamp")
    g = grouped(cleaned(w), [F.weekday(bought).alias("day"), F.date_format(bought, "EEEE").alias("purchase_weekday")],
                total_orders=rows(), sla_compliant=mean("sla_compliant", 6), delay_days=mean("delay_days", 6))
    return g.orderBy("day").drop("day")


@analysis("delivery_recommendations")
def recommendations(w):
    """Rules over the summaries; a rule that does not hold gives no row."""
    def first(column, by):
        return F.min_by(column, F.struct(by, column))

    sla = F.col("sla_compliant")
    region = sla_by_region(w).agg(
        first("region", sla).alias("worst"), first("region", -sla).alias("best"),
        F.min(sla).alias("low"), F.max(sla).alias("high"))
    freight = sla_by_freight(w).agg(first("freight_category", -sla).alias("best"))
    severe = whole(cleaned(w), share=rate_where(F.col("delay_days") > 15, 6))
    month = sla_by_month(w).agg(first("purchase_month", sla).alias("worst"), F.min(sla).alias("low"),
                                rnd(F.avg(sla), 6).alias("avg"))

    def rule(df, priority, area, text, impact):
        return df.select(F.lit(priority).alias("priority"), F.lit(area).alias("area"),
                         text.alias("recommendation"), F.lit(impact).alias("expected_impact"))

    def percent(c):
        return F.format_string("%.1f%%", F.col(c) * 100)

    return (
        rule(region, "High", "Regional Logistics",
             F.concat(F.lit("Focus on improving "), "worst", F.lit(" region logistics. Current SLA: "),
                      percent("low"), F.lit(" vs Best region ("), "best", F.lit("): "), percent("high")),
             "Improve SLA by 5-10% in worst performing region")
        .unionByName(rule(freight, "Medium", "Freight Cost",
                          F.concat(F.lit("Optimize freight to "), "best",
                                   F.lit(" category range for best SLA compliance")),
                          "Better cost-performance ratio"))
        .unionByName(rule(severe.where("share > 5"), "High", "Customer Experience",
                          F.lit("Implement expedited shipping for orders at risk of >15 day delays"),
                          "Reduce negative reviews by 15-20%"))
        .unionByName(rule(month.where("low < avg * 0.9"), "Medium", "Seasonal Planning",
                          F.concat(F.lit("Increase logistics capacity in month "),
                                   F.col("worst").cast("string")),
                          "Smooth seasonal fluctuations"))
    )


@analysis("delivery_delayed_orders")
def delayed_orders(w):
    return cleaned(w).where(_late()).select(
        "order_id", "customer_state", "region", "total_delivery_days", "delay_days",
        "delivery_status", "freight_value", "review_score").orderBy(F.desc("delay_days"), "order_id")


@analysis("delivery_regional_summary")
def regional_summary(w):
    return _regional(w, 3)


@analysis("delivery_improvement_priorities")
def improvement_priorities(w):
    return top(_states(w), 10, "sla_compliant", "customer_state").select(
        "customer_state", "sla_compliant", "delay_days", "total_orders")


@analysis("delivery_key_metrics")
def key_metrics(w):
    row = whole(cleaned(w), **{
        "Total Orders": rows(), "SLA Compliance Rate": mean("sla_compliant", 6),
        "Average Delivery Time (days)": mean("total_delivery_days", 6),
        "Average Delay (days)": F.coalesce(mean(F.when(_late(), F.col("delay_days")), 6), F.lit(0.0)),
        "Delayed Orders Count": F.count_if(_late()),
        "Delayed Orders Percentage": rnd(ratio(F.count_if(_late()), rows()), 6),
        "Average Freight Cost (R$)": rnd(money_avg("freight_value"), 6),
        "Average Review Score": mean("review_score", 6),
        "Delay-Review Correlation": rnd(pearson("delay_days", "review_score"), 6),
        "Freight-SLA Correlation": rnd(pearson("freight_value", "sla_compliant"), 6)})
    return metric_rows(row)
