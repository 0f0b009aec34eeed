import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.functions import (
    bins, cents, initcap_words, lookup, money_avg, money_sum, month_diff, pearson, ranges, ratio, rnd,
    season, to_long, week_start,
)
from martloom.plans.customer import rfm_codes
from martloom.plans.operational import INSTALLMENT_BINS


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("value, digits, expected", [
    (1.005, 2, 1.01), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (1.0049999999999, 2, 1.01),
    (12.344, 2, 12.34),
])
def test_round_half_away(spark, value, digits, expected):
    assert one(spark, x=rnd(F.lit(value), digits)).x == expected


def test_float_to_integer_rounds(spark):
    r = one(spark, a=to_long(F.lit(2.7)), b=to_long(F.lit(2.5)), c=to_long(F.lit(-0.5)))
    assert (r.a, r.b, r.c) == (3, 3, -1)


def test_money_is_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(None,)], "v double")
    r = df.agg(money_sum("v").alias("s"), money_avg("v").alias("a"), F.sum(cents("v")).alias("c")).first()
    assert (r.s, r.a, r.c) == (100.0, 0.1, 10000)
    empty = df.where("v > 1").agg(money_sum("v").alias("s"), money_avg("v").alias("a")).first()
    assert empty.s is None and empty.a is None


@pytest.mark.parametrize("end, start, months", [
    ("2021-03-01", "2021-01-31", 2), ("2021-01-01", "2020-12-31", 1), ("2020-02-29", "2020-02-01", 0),
    ("2020-12-31", "2021-01-01", -1),
])
def test_month_boundaries(spark, end, start, months):
    d = {k: F.lit(dt.date.fromisoformat(v)) for k, v in (("e", end), ("s", start))}
    assert one(spark, x=month_diff(d["e"], d["s"])).x == months


@pytest.mark.parametrize("day, sunday", [
    ("2024-03-02", "2024-02-25"), ("2024-03-03", "2024-03-03"), ("2024-03-04", "2024-03-03"),
    ("2024-02-29", "2024-02-25"),
])
def test_weeks_begin_on_sunday(spark, day, sunday):
    got = one(spark, x=week_start(F.lit(dt.date.fromisoformat(day)))).x
    assert got == dt.date.fromisoformat(sunday)


@pytest.mark.parametrize("text, expected", [
    ("mogi-guacu", "Mogi-Guacu"), ("SAO PAULO", "Sao Paulo"), ("d'oeste", "D'oeste"),
    ("santa (rio)", "Santa (Rio)"), ("", ""), (None, None),
])
def test_title_case_breaks_on_punctuation(spark, text, expected):
    assert one(spark, x=initcap_words(F.lit(text).cast("string"))).x == expected


def test_bins_take_the_first_match(spark):
    steps = [(50, "low"), (150, "mid")]
    got = spark.createDataFrame([(49.0,), (50.0,), (150.0,), (151.0,), (None,)], "v double").select(
        bins("v", steps, "top").alias("closed"), bins("v", steps, "top", closed=False).alias("open")).collect()
    assert [r.closed for r in got] == ["low", "low", "mid", "top", "top"]
    assert [r.open for r in got] == ["low", "mid", "top", "top", "top"]


@pytest.mark.parametrize("average, label", [
    (1.0, "1x"), (1.5, "Unknown"), (2.0, "2-3x"), (3.5, "Unknown"), (12.0, "7-12x"), (13.0, "13+x"),
    (None, "Unknown"),
])
def test_average_installments_between_bins(spark, average, label):
    assert one(spark, x=ranges(F.lit(average).cast("double"), INSTALLMENT_BINS, "Unknown")).x == label


def test_ratio_of_zero(spark):
    r = one(spark, a=ratio(F.lit(1), F.lit(0)), b=ratio(F.lit(1), F.lit(None)), c=ratio(F.lit(1), F.lit(4)))
    assert (r.a, r.b, r.c) == (None, None, 0.25)


def test_correlation_edges(spark):
    def corr(rows):
        return spark.createDataFrame(rows, "x double, y double").agg(pearson("x", "y").alias("c")).first().c

    assert corr([(1.0, 1.0)]) is None
    assert corr([(1.0, 2.0), (1.0, 3.0)]) is None
    assert corr([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1.0)
    assert corr([(1.0, 2.0), (2.0, 1.0), (3.0, None)]) == pytest.approx(-1.0)


def test_rfm_codes_listed_twice_keep_the_first_segment(spark):
    table = rfm_codes()
    assert table["231"] == table["241"] == "About to Sleep"
    assert table["322"] == "Hibernating" and table["335"] == "Loyal Customers"
    assert one(spark, x=lookup(F.lit("999"), table, "Other")).x == "Other"
    assert one(spark, x=lookup(F.lit("555"), table, "Other")).x == "Champions"


def test_southern_seasons(spark):
    got = [one(spark, x=season(F.lit(m))).x for m in (1, 4, 7, 10, 12)]
    assert got == ["Summer", "Fall", "Winter", "Spring", "Summer"]
