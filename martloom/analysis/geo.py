"""State opportunity and strategy, from the geographic mart (one row per state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import lookup, ratio, rnd
from martloom.functions.fixed import STATE_STRATEGY
from martloom.reports.common import top


def with_opportunity(states: DataFrame) -> DataFrame:
    """Revenue if every customer were worth the best state average of the region."""
    best = F.max("avg_ltv").over(Window.partitionBy("region"))
    missing = best - F.col("avg_ltv")
    return states.withColumns({
        "revenue_opportunity": rnd(missing * F.col("total_customers"), 6),
        "ltv_gap_pct": rnd(ratio(missing, "avg_ltv") * 100, 6)})


def with_strategy(states: DataFrame) -> DataFrame:
    """Strategy group by the quartiles of customers and lifetime value over the states."""
    everything = Window.partitionBy()

    def quartile(c: str, p: float):
        return rnd(F.percentile(c, p).over(everything), 6)

    marked = states.withColumns({
        "_c1": quartile("total_customers", 0.25), "_c3": quartile("total_customers", 0.75),
        "_v1": quartile("avg_ltv", 0.25), "_v3": quartile("avg_ltv", 0.75)})
    n, v = F.col("total_customers"), F.col("avg_ltv")
    group = (F.when((n >= F.col("_c3")) & (v <= F.col("_v1")), "Optimization Needed")
             .when(v.between(F.col("_v1"), F.col("_v3")) & (n >= F.col("_c1")), "Growth Opportunities")
             .otherwise("Early Stage"))
    return marked.withColumn("strategy_group", group).drop("_c1", "_c3", "_v1", "_v3")


def with_actions(states: DataFrame) -> DataFrame:
    def part(i: int):
        return lookup("strategy_group", {k: v[i] for k, v in STATE_STRATEGY.items()})

    return states.select(
        "state_code", "strategy_group", F.col("avg_ltv").alias("current_ltv"), "total_customers",
        part(0).alias("action_primary"), part(1).alias("primary_channel"),
        (part(2) * F.col("total_customers")).alias("budget_suggested"),
        part(3).alias("roi_expected"), rnd(part(4) * F.col("avg_ltv"), 6).alias("ltv_target"))


def _states(w) -> DataFrame:
    return w.mart("geographic_performance").select(
        F.col("customer_state").alias("state_code"), F.col("customer_region").alias("region"),
        "avg_ltv", "total_customers", "total_revenue", F.col("avg_aov").alias("avg_order_value"))


@analysis("geo_opportunity")
def opportunity(w):
    return with_opportunity(_states(w))


@analysis("geo_top_opportunities")
def top_opportunities(w):
    return top(opportunity(w), 20, F.desc("revenue_opportunity"), "state_code").select(
        "state_code", "region", "revenue_opportunity", "ltv_gap_pct", "avg_ltv", "total_customers")


@analysis("geo_strategy")
def strategy(w):
    return with_strategy(opportunity(w)).select(
        "state_code", "region", "strategy_group", "avg_ltv", "total_customers", "total_revenue",
        "revenue_opportunity")


@analysis("geo_strategy_actions")
def strategy_actions(w):
    return with_actions(strategy(w))


@analysis("geo_performance")
def performance(w):
    return w.mart("geographic_performance").select(
        "customer_state", "customer_region", "total_revenue", "avg_ltv", "repurchase_rate",
        "revenue_concentration_pct", "growth_potential", "ltv_rank", "revenue_rank"
    ).orderBy("revenue_rank")
