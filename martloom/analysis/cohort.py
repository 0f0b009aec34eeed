"""Cohort analyses on the retention mart: a few rows per cohort and month, so plain windows do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.analysis.common import analysis
from martloom.functions import cents, from_cents, lookup, money_sum, pct, pearson, ratio, rnd
from martloom.functions.fixed import COHORT_GROUP_TEXT
from martloom.reports.common import grouped, mean, money_mean, rows, top, whole

OFFSET = "months_since_first_purchase"


def _mart(w):
    return w.mart("customer_cohort_retention")


def _line():
    return Window.partitionBy("cohort_month").orderBy(OFFSET)


def _at(month, value="retention_rate"):
    return F.max(F.when(F.col(OFFSET) == month, F.col(value)))


def _m3(w):
    return _mart(w).where(F.col(OFFSET) == 3).select(
        "cohort_month", "cohort_size", "retention_rate", "retained_customers")


@analysis("cohort_overview")
def overview(w):
    start = F.col(OFFSET) == 0
    return whole(_mart(w), total_cohorts=F.count_if(start),
                 total_customers=F.sum(F.when(start, F.col("cohort_size"))),
                 first_cohort=F.min("cohort_month"), last_cohort=F.max("cohort_month"),
                 avg_cohort_size=mean(F.when(start, F.col("cohort_size"))))


@analysis("cohort_retention_pivot")
def retention_pivot(w):
    months = list(range(13))
    wide = _mart(w).groupBy("cohort_month").pivot(OFFSET, months).agg(F.max("retention_rate"))
    return wide.select("cohort_month", *[F.col(str(k)).alias(f"m{k}") for k in months]).orderBy(
        F.desc("cohort_month"))


@analysis("cohort_m3_summary")
def m3_summary(w):
    value = F.col("retention_rate")
    return whole(_m3(w), avg_m3=mean(value), best_m3=F.max(value), worst_m3=F.min(value),
                 best_cohort=F.min_by("cohort_month", F.struct(-value, "cohort_month")),
                 worst_cohort=F.min_by("cohort_month", F.struct(value, "cohort_month")),
                 variation=rnd(F.max(value) - F.min(value)))


@analysis("cohort_curve")
def curve(w, support: int = 3):
    """Mean and deviation of retention per offset with at least ``support`` cohorts."""
    g = grouped(_mart(w), [OFFSET], avg_retention_rate=mean("retention_rate", 6),
                std_retention_rate=rnd(F.stddev_samp("retention_rate"), 6), cohort_count=rows())
    return g.where(F.col("cohort_count") >= support).orderBy(OFFSET)


@analysis("cohort_decay_m1_m3")
def decay_m1_m3(w):
    c = curve(w)
    row = whole(c, m1=F.max(F.when(F.col(OFFSET) == 1, F.col("avg_retention_rate"))),
                m3=F.max(F.when(F.col(OFFSET) == 3, F.col("avg_retention_rate"))))
    return row.withColumn("decay_pct", rnd(ratio(F.col("m3") - F.col("m1"), "m1") * 100, 4))


@analysis("cohort_dropoff")
def dropoff(w):
    """Largest fall of retention of each cohort, with the offset where it happened."""
    steps = _mart(w).withColumn(
        "change", rnd(F.col("retention_rate") - F.lag("retention_rate").over(_line())))
    return steps.where("change < 0").groupBy("cohort_month").agg(
        F.min_by(OFFSET, F.struct("change", OFFSET)).alias("max_drop_month"),
        F.min("change").alias("max_drop_value"),
        F.max("cohort_size").alias("initial_size"))


@analysis("cohort_dropoff_by_month")
def dropoff_by_month(w):
    return grouped(dropoff(w), ["max_drop_month"], cohort_count=rows(),
                   avg_drop_value=mean("max_drop_value", 6),
                   total_customers_affected=F.sum("initial_size")).orderBy("max_drop_month")


@analysis("cohort_stability")
def stability(w):
    """Retention at the 1st, 2nd, 4th and 7th observed month, changes, and any fall."""
    seen = _mart(w).select(
        "cohort_month", "retention_rate", F.row_number().over(_line()).alias("k"),
        (F.col("retention_rate") - F.lag("retention_rate").over(_line())).alias("change"))

    def kth(k):
        return F.max(F.when(F.col("k") == k, F.col("retention_rate")))

    g = grouped(seen, ["cohort_month"], n=rows(), initial_retention=kth(1), m1_retention=kth(2),
                m3_retention=kth(4), m6_retention=kth(7),
                has_any_drop=F.coalesce(F.bool_or(F.col("change") < 0), F.lit(False)))
    return g.where("n > 1").drop("n").withColumns({
        "m1_to_m3_change": rnd(F.col("m3_retention") - F.col("m1_retention")),
        "m3_to_m6_change": rnd(F.col("m6_retention") - F.col("m3_retention"))})


@analysis("cohort_natural_decay")
def natural_decay(w):
    """Change of mean retention from each offset to the next, up to a year."""
    means = grouped(_mart(w), [OFFSET], avg=mean("retention_rate", 6))
    later = means.select((F.col(OFFSET) - 1).alias(OFFSET), F.col("avg").alias("next"))
    return means.where(F.col(OFFSET) < 12).join(later, OFFSET).select(
        F.col(OFFSET).alias("from_month"), (F.col(OFFSET) + 1).alias("to_month"),
        F.col("avg").alias("avg_retention_from"), F.col("next").alias("avg_retention_to"),
        F.coalesce(rnd(ratio(F.col("next") - F.col("avg"), "avg") * 100, 4), F.lit(0.0)).alias("decay_pct"),
        rnd(F.col("next") - F.col("avg"), 6).alias("absolute_change")).orderBy("from_month")


@analysis("cohort_best_worst")
def best_worst(w):
    m3 = _m3(w)
    best = top(m3, 5, F.desc("retention_rate"), "cohort_month").withColumn("group", F.lit("Top 5"))
    worst = top(m3, 5, "retention_rate", F.desc("cohort_month")).withColumn("group", F.lit("Bottom 5"))
    return best.unionByName(worst)


@analysis("cohort_gap")
def gap(w):
    is_top = F.col("group") == "Top 5"
    row = whole(best_worst(w), top_avg=mean(F.when(is_top, F.col("retention_rate")), 6),
                bottom_avg=mean(F.when(~is_top, F.col("retention_rate")), 6),
                top_customers=F.sum(F.when(is_top, F.col("retained_customers"))),
                bottom_customers=F.sum(F.when(~is_top, F.col("retained_customers"))))
    return row.withColumns({"retention_gap": rnd(F.col("top_avg") - F.col("bottom_avg"), 6),
                            "customer_gap": F.col("top_customers") - F.col("bottom_customers")})


@analysis("cohort_revenue_by_offset")
def revenue_by_offset(w):
    return grouped(_mart(w), [OFFSET], cohort_revenue=money_sum("cohort_revenue"),
                   revenue_per_customer=mean("revenue_per_customer", 6),
                   retention_rate=mean("retention_rate", 6),
                   cumulative_revenue=money_mean("cumulative_revenue")).orderBy(OFFSET)


@analysis("cohort_revenue_split")
def revenue_split(w):
    month, c = F.col(OFFSET), F.sum(cents("cohort_revenue"))
    parts = {"m0_pct": month == 0, "m1_m3_pct": month.between(1, 3), "m4_plus_pct": month >= 4}
    shares = whole(_mart(w), total_revenue=from_cents(c), **{
        k: rnd(pct(F.sum(F.when(cond, cents("cohort_revenue"))), c), 4) for k, cond in parts.items()})
    return shares.withColumn("revenue_retention_correlation", revenue_by_offset(w).agg(
        rnd(pearson("revenue_per_customer", "retention_rate"), 6)).scalar())


@analysis("cohort_ltv")
def cohort_ltv(w):
    """Lifetime value per cohort with a three-cohort moving average."""
    g = grouped(_mart(w), ["cohort_month", "cohort_size"],
                total_cumulative_revenue=F.max("cumulative_revenue"), m3_retention=_at(3))
    value = rnd(ratio("total_cumulative_revenue", "cohort_size"), 6)
    trailing = Window.orderBy("cohort_month").rowsBetween(-2, 0)  # one row per cohort
    return g.withColumn("avg_ltv", value).withColumn("avg_ltv_ma3", rnd(F.avg("avg_ltv").over(trailing), 6))


@analysis("cohort_correlations")
def correlations(w):
    return whole(cohort_ltv(w), avg_ltv_all=mean("avg_ltv", 6), max_ltv=F.max("avg_ltv"),
                 min_ltv=F.min("avg_ltv"), size_ltv_correlation=rnd(pearson("cohort_size", "avg_ltv"), 6),
                 retention_ltv_correlation=rnd(pearson("m3_retention", "avg_ltv"), 6))


def _ranked(w):
    """Fractional rank of month-3 retention, ties sharing their mean rank."""
    same, everything = Window.partitionBy("retention_rate"), Window.partitionBy()
    first = F.rank().over(Window.orderBy("retention_rate"))
    ties = F.count(F.lit(1)).over(same)
    share = (first + (ties - 1) / 2.0) / F.count(F.lit(1)).over(everything)
    return _m3(w).withColumn("place", rnd(share, 6)).withColumn(
        "cohort_group", F.when(F.col("place") >= 0.7, "High Performers")
        .when(F.col("place") >= 0.3, "Medium Performers").otherwise("Low Performers"))


@analysis("cohort_groups")
def groups(w):
    g = grouped(_ranked(w), ["cohort_group"], cohort_count=rows(), total_customers=F.sum("cohort_size"),
                avg_m3_retention=mean("retention_rate", 4))
    action = {k: v[0] for k, v in COHORT_GROUP_TEXT.items()}
    channel = {k: v[1] for k, v in COHORT_GROUP_TEXT.items()}
    return g.withColumns({"action": lookup("cohort_group", action),
                          "channel": lookup("cohort_group", channel)})


@analysis("cohort_low_performers")
def low_performers(w):
    return _ranked(w).where("cohort_group = 'Low Performers'").select(
        "cohort_month", "cohort_size", "retention_rate").orderBy("cohort_month")
