"""Closed formulas against published result figures (literals)."""

import pytest
from pyspark.sql import functions as F

from martloom.analysis.finance import pl_components
from martloom.analysis.geo import with_actions, with_opportunity, with_strategy

# state, region, average lifetime value, customers
STATES = [
    ("AC", "Norte", 247.42, 77), ("AM", "Norte", 190.94, 144), ("AP", "Norte", 240.92, 67),
    ("AL", "Nordeste", 237.26, 395), ("SP", "Sudeste", 142.76, 40075), ("RJ", "Sudeste", 166.62, 12238),
]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(STATES, "state_code string, region string, avg_ltv double, total_customers long")


def test_opportunity(states):
    got = {r.state_code: (r.revenue_opportunity, r.ltv_gap_pct) for r in with_opportunity(states).collect()}
    assert got["AM"] == (pytest.approx(8133.12, abs=1e-3), pytest.approx(29.57997276631402, abs=1e-5))
    assert got["AP"] == (pytest.approx(435.5, abs=1e-3), pytest.approx(2.697991034368255, abs=1e-5))
    assert got["AC"] == (0.0, 0.0)


def test_strategy_actions(states):
    grouped = states.withColumn("strategy_group", F.when(F.col("state_code") == "SP", "Optimization Needed")
                                .otherwise("Early Stage"))
    got = {r.state_code: r for r in with_actions(grouped).collect()}
    assert (got["AC"].budget_suggested, got["AC"].roi_expected, got["AC"].ltv_target) == (2310, 15, 371.13)
    assert (got["AL"].budget_suggested, got["AL"].ltv_target) == (11850, 355.89)
    assert got["SP"].budget_suggested == 15 * 40075 and got["SP"].roi_expected == 30


def test_strategy_groups(spark):
    rows = [("a", "r", 100.0, 1000), ("b", "r", 200.0, 500), ("c", "r", 300.0, 10), ("d", "r", 150.0, 400),
            ("e", "r", 250.0, 20)]
    df = spark.createDataFrame(rows, "state_code string, region string, avg_ltv double, total_customers long")
    got = {r.state_code: r.strategy_group for r in with_strategy(df).collect()}
    assert got == {"a": "Optimization Needed", "b": "Growth Opportunities", "c": "Early Stage",
                   "d": "Growth Opportunities", "e": "Growth Opportunities"}


def test_profit_and_loss_formula(spark):
    lines = pl_components(F.lit(7980.16), F.lit(1533.4), F.lit(381675), 50.0)
    r = spark.range(1).select(*[c.alias(k) for k, c in lines.items()]).first().asDict()
    assert r["Variable Costs"] == pytest.approx(4788.096)
    assert r["CAC Total"] == 19083750.0
    assert r["Freight Cost"] == pytest.approx(1226.72)
    assert r["Contribution Margin"] == pytest.approx(-19082091.332, abs=0.02)
    assert r["Margin %"] == pytest.approx(-239119.157, abs=0.01)


def test_growth_from_published_months(spark):
    months = [("2017-01-01", 131320.57), ("2017-02-01", 272041.46), ("2017-03-01", 415057.5)]
    df = spark.createDataFrame(months, "d string, v double")
    from pyspark.sql import Window

    from martloom.functions import ratio
    before = F.lag("v").over(Window.orderBy("d"))
    got = [r.g for r in df.select((ratio(F.col("v") - before, before) * 100).alias("g")).collect()]
    assert got == [None, pytest.approx(107.1582997241026), pytest.approx(52.571413195621176)]
