"""Churn of customers after their purchases: features, selection, models, scores.

Training, evaluation and scoring run on ``pyspark.ml``; only model summaries (importances,
correlations of the candidate features) reach the driver.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions import bins, day_diff, lookup, pearson, ratio, rnd, season
from martloom.functions.fixed import BIG_STATES, REGION_SHORT
from martloom.operators.ranking import global_position, literals, quantile_scalars, value_profile
from martloom.operators.storage import settled

CANDIDATES = (
    "recency", "recency_sqrt", "time_churn_prob", "total_revenue", "revenue_log", "is_high_value",
    "is_low_value", "value_per_day", "purchase_year", "purchase_month", "purchase_dayofweek",
    "is_weekend_purchase", "purchase_season", "customer_state", "customer_region", "is_big_state",
    "revenue_zscore", "is_revenue_outlier", "value_time_ratio", "recency_value_interaction",
)
TEXT = ("purchase_season", "customer_state", "customer_region")
HORIZON_DAYS = 713
SEED = 42


def reference_dates(ltv: DataFrame, reference: dt.date) -> DataFrame:
    """Date range and churn rate for three inactivity limits."""
    idle = day_diff(F.lit(reference), "last_purchase_date")
    return ltv.where("last_purchase_date is not null").agg(
        F.to_date(F.min("first_purchase_date")).alias("min_purchase_date"),
        F.to_date(F.max("last_purchase_date")).alias("max_purchase_date"),
        F.count_distinct("customer_id").alias("total_customers"),
        *[rnd(F.avg(F.when(idle > d, 1.0).otherwise(0.0)), 6).alias(f"churn_rate_{d}") for d in (90, 180, 365)])


def churn_customers(
    ltv: DataFrame, reference: dt.date, max_orders: int | None = 1, limit_days: int = 180
) -> DataFrame:
    """Customers with at most ``max_orders`` orders, described by the first one, with the label."""
    known = ltv.where("first_purchase_date is not null and last_purchase_date is not null")
    if max_orders is not None:
        known = known.where(F.col("total_orders") <= max_orders)
    first, value = F.to_date("first_purchase_date"), F.col("avg_order_value")
    recency = day_diff(F.lit(reference), "last_purchase_date")
    spent = F.col("total_revenue")
    return known.where(recency >= 0).select(
        "customer_id", "customer_state", "customer_region", "total_orders", "total_revenue",
        "avg_order_value", "customer_lifespan_days", "first_purchase_date", "last_purchase_date",
        recency.alias("recency"),
        day_diff(F.lit(reference), "first_purchase_date").alias("tenure_days"),
        F.date_format(first, "yyyy-MM").alias("purchase_year_month"),
        season(F.month(first)).alias("purchase_season"),
        F.date_format(first, "EEEE").alias("purchase_weekday"),
        bins(value, [(50, "Low (<50)"), (150, "Medium (50-150)"), (300, "High (150-300)")],
             "Very High (>300)", closed=False).alias("order_value_category"),
        F.when(value < spent * 0.9, "Below Average").when(value > spent * 1.1, "Above Average")
        .otherwise("Average").alias("value_vs_expected"),
        (recency > limit_days).cast("int").alias("is_churned"),
    )


def churn_features(customers: DataFrame) -> DataFrame:
    """Temporal, value, date, place, interaction and statistical features."""
    q25, q75 = quantile_scalars(customers, "total_revenue", [0.25, 0.75])
    moments = literals(customers.agg(*[
        rnd(f(c), 8).alias(f"{n}_{c}") for c in ("total_revenue", "recency")
        for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]))
    days, spent = F.col("recency"), F.col("total_revenue")
    first = F.to_date("first_purchase_date")
    month, weekday = F.month(first), F.weekday(first)
    angle = month * (2 * math.pi / 12)
    region = F.coalesce(lookup("customer_region", REGION_SHORT), "customer_region", F.lit("Other"))

    def z(c: str) -> Column:
        return ratio(F.col(c) - moments[f"mean_{c}"], moments[f"sd_{c}"])

    return customers.withColumns({
        "recency_log": rnd(F.log1p(days), 6),
        "recency_sqrt": rnd(F.sqrt(days), 6),
        "recency_binned": bins(days, [(30, "0-30"), (90, "31-90"), (180, "91-180"), (365, "181-365")], "365+"),
        "time_churn_prob": rnd(days / F.lit(float(HORIZON_DAYS)), 6),
        "revenue_log": rnd(F.log1p(spent), 6),
        "revenue_sqrt": rnd(F.sqrt(spent), 6),
        "value_segment": F.when(spent <= q25, "Low").when(spent <= q75, "Medium").otherwise("High"),
        "is_high_value": (spent > q75).cast("int"),
        "is_low_value": (spent < q25).cast("int"),
        "value_per_day": rnd(spent / (days + 1), 6),
        "purchase_year": F.year(first),
        "purchase_month": month,
        "purchase_day": F.dayofmonth(first),
        "purchase_dayofweek": weekday,
        "purchase_quarter": F.quarter(first),
        "purchase_month_sin": rnd(F.sin(angle), 6),
        "purchase_month_cos": rnd(F.cos(angle), 6),
        "is_weekend_purchase": weekday.isin(5, 6).cast("int"),
        "is_month_end": (F.dayofmonth(first) >= 25).cast("int"),
        "customer_region": region,
        "is_big_state": F.col("customer_state").isin(*BIG_STATES).cast("int"),
        "is_southeast": (region == "SE").cast("int"),
        "value_time_ratio": rnd(spent / (days + 1), 6),
        "recency_value_interaction": rnd(days * spent, 6),
        "value_aov_ratio": rnd(ratio(spent, F.col("avg_order_value") + 0.01), 6),
        "revenue_zscore": rnd(z("total_revenue"), 6),
        "is_revenue_outlier": (F.abs(z("total_revenue")) > 3).cast("int"),
        "recency_zscore": rnd(z("recency"), 6),
    })


def imputed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """NULL numbers become the median, NULL texts the most frequent value."""
    fills = {}
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    for c in columns:
        if missing[c] == 0:
            continue
        if c in TEXT:
            mode = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(
                F.max_by(c, F.struct("n", c)).alias("v")).scalar()
            fills[c] = F.coalesce(F.col(c), mode, F.lit("Unknown"))
        else:
            fills[c] = F.coalesce(F.col(c).cast("double"), quantile_scalars(df, c, [0.5])[0])
    return df.withColumns(fills) if fills else df


def _seq(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _alias_edges(expr, edges: dict[int, set[int]]) -> None:
    """Every alias inside ``expr``: its id -> ids of the attributes its expression reads."""
    if expr.getClass().getSimpleName() == "Alias":
        edges.setdefault(expr.exprId().id(), set()).update(
            a.exprId().id() for a in _seq(expr.child().references().toSeq()))
    for child in _seq(expr.children()):
        _alias_edges(child, edges)


def leaking_columns(features: DataFrame, label: str = "is_churned") -> list[str]:
    """Columns of ``features`` made, at any depth of its plan, from what the label is made of.

    Walks the analysed plan: every alias links its id to the attributes its expression reads, so
    the columns read by the label's expression and everything computed from them (directly or via
    other columns) are found. Columns read from storage start a new lineage.
    """
    plan = features._jdf.queryExecution().analyzed()
    edges: dict[int, set[int]] = {}
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        nodes += _seq(node.children())
        for expr in _seq(node.expressions()):
            _alias_edges(expr, edges)
    ids = {a.name(): a.exprId().id() for a in _seq(plan.output())}
    inputs = edges.get(ids[label], set())

    def reaches(start: int) -> bool:
        seen, todo = set(), [start]
        while todo:
            i = todo.pop()
            if i in inputs:
                return True
            if i not in seen:
                seen.add(i)
                todo += edges.get(i, ())
        return False

    return [c for c in features.columns if c != label and reaches(ids[c])]


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair of ``columns``, all in one pass over ``df`` (NULL where a
    column does not vary).

    A row becomes one (pair, x, y) row per pair and the pairs are groups of one small aggregate: one
    aggregate over all pairs at once is too wide for generated code and took about 1 ms a row.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    if not pairs:
        return {}
    values = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    later = values.select("v", F.posexplode("v").alias("i", "x"))
    both = later.select("i", "x", F.posexplode(F.slice("v", F.lit(1), F.col("i"))).alias("j", "y"))
    # One row a pair.
    found = both.groupBy("i", "j").agg(pearson("x", "y").alias("r")).collect()
    return dict.fromkeys(pairs) | {(columns[r.i], columns[r.j]): r.r for r in found}


TRANSFORMED = ("_log", "_sqrt", "zscore")


def select_features(df: DataFrame, candidates: list[str] | tuple[str, ...] = CANDIDATES,
                    limit: float = 0.8) -> list[str]:
    """``candidates`` without one numeric column of each pair correlated beyond ``limit``.

    Strong pairs are settled in matrix order (by the later column, then the earlier one); a pair
    with a column already dropped is skipped. Of a pair, a transformed column goes (the later one
    first); otherwise the one with the smaller sample variance, the earlier one on equal variance.
    """
    numeric = [c for c in candidates if c not in TEXT]
    r = correlations(df, numeric)
    variance = df.agg(*[F.var_samp(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    strong = sorted((numeric.index(a), numeric.index(b), a, b) for (a, b), v in r.items()
                    if v is not None and abs(v) > limit)

    def loser(later: str, earlier: str) -> str:
        for c in (later, earlier):
            if any(t in c for t in TRANSFORMED):
                return c
        return later if variance[later] < variance[earlier] else earlier

    dropped: list[str] = []
    for _, _, later, earlier in strong:
        if later not in dropped and earlier not in dropped:
            dropped.append(loser(later, earlier))
    return [c for c in candidates if c not in dropped]


def split_parts(df: DataFrame, test_part: int = 5, label: str = "is_churned") -> DataFrame:
    """``df`` with ``part`` ('test' or 'train'): of each label's n rows, exactly
    ``floor(n / test_part + 1/2)`` are test rows, chosen by the order of ``md5(customer_id:seed)``
    (ties by customer_id), so every engine picks the same rows and shares per label differ from
    ``1 / test_part`` by less than one row.

    The place inside a label comes from a distributed position over (label, hash, customer): range
    partitions and their offsets, never one task for a label; a label's first place is the number of
    rows of smaller labels, read from a per-label count.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f":{SEED}"))))
    placed = global_position(hashed, [F.col(label).asc_nulls_first(), F.col("_h"), F.col("customer_id")], "_pos")
    counts = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # One row a label.
    before = Window.orderBy(F.col(label).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(label, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    quota = F.floor((F.col("_n") * 2 + test_part) / (2 * test_part))
    joined = placed.join(F.broadcast(starts), placed[label].eqNullSafe(starts[label])).drop(starts[label])
    part = F.when(F.col("_pos") - F.col("_start") <= quota, "test").otherwise("train")
    return joined.withColumn("part", part).drop("_h", "_pos", "total_rows", "_n", "_start")


def split(df: DataFrame, test_part: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test part, stratified by label with an exact quota (``split_parts``)."""
    parts = settled(split_parts(df, test_part))
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


def with_weights(train: DataFrame) -> DataFrame:
    """Weights that give both labels the same total."""
    n = literals(train.agg(F.count(F.lit(1)).alias("all"), F.sum("is_churned").alias("pos")))
    mine = F.when(F.col("is_churned") == 1, n["pos"]).otherwise(n["all"] - n["pos"])
    return train.withColumn("weight", n["all"] / (mine * 2.0))


@dataclass
class ChurnData:
    """Encoded customers and their division into training and test part; the encoding is learned
    from the training part."""

    features: list[str]
    slots: list[str]
    prepared: DataFrame
    train: DataFrame
    test: DataFrame


@dataclass
class ChurnModels(ChurnData):
    models: dict[str, object]

    def predicted(self, name: str, df: DataFrame | None = None) -> DataFrame:
        scored = self.models[name].transform(self.test if df is None else df)
        return scored.withColumn("churn_probability", vector_to_array("probability")[1])


def categorical(df: DataFrame, features: list[str], few: int = 10) -> list[str]:
    """Text columns, and number columns with fewer than ``few`` distinct values over all rows (each
    test reads at most ``few`` distinct values)."""
    return [c for c in features
            if c in TEXT or df.where(F.col(c).isNotNull()).select(c).distinct().limit(few).count() < few]


def fit_encoder(train: DataFrame, features: list[str], categories: list[str]) -> tuple[list[Column], list[str]]:
    """Columns and slot names of the encoding, learned from ``train`` alone.

    Numbers first, in feature order, scaled by the training mean and population deviation (a
    constant column becomes 0). Then, per categorical column in feature order, one slot for every
    training category but the first (ascending), and a last slot ``<column>_unknown`` for values
    not seen in training or null, so that no test row loses its category silently.
    """
    numbers = [c for c in features if c not in categories]
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in numbers],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in numbers]).first() if numbers else None
    cols, slots = [], []
    for c in numbers:
        centred = F.col(c).cast("double") - F.lit(stats[f"m_{c}"])
        cols.append(centred / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else centred * 0.0)
        slots.append(c)
    for c in categories:
        # A categorical column has few values (fewer than ten, or a text dimension such as states).
        seen = sorted(r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().collect())
        for v in seen[1:]:
            cols.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)))
            slots.append(f"{c}_{v}")
        known = F.col(c).isin(*seen) if seen else F.lit(False)
        cols.append(F.when(F.col(c).isNull() | ~known, 1.0).otherwise(0.0))
        slots.append(f"{c}_unknown")
    return cols, slots


def encoded(df: DataFrame, cols: list[Column]) -> DataFrame:
    slots = df.select("customer_id", "customer_state", "total_revenue", "is_churned",
                      *[c.alias(f"_s{i}") for i, c in enumerate(cols)])
    return VectorAssembler(inputCols=[f"_s{i}" for i in range(len(cols))], outputCol="features").transform(
        slots).select("customer_id", "customer_state", "total_revenue", "is_churned", "features")


def training_data(features_df: DataFrame, leaking: list[str] | None = None) -> ChurnData:
    """Imputed, selected and encoded features without the ones that give the label away.

    ``leaking`` defaults to the lineage of ``features_df``; pass the lineage of the unstored plan
    when ``features_df`` was read back from storage. Leaking columns go before the correlation step.
    """
    filled = settled(imputed(features_df, CANDIDATES))
    gone = set(leaking_columns(features_df) if leaking is None else leaking)
    chosen = select_features(filled, [c for c in CANDIDATES if c not in gone])
    train, test = split(filled)
    cols, slots = fit_encoder(train, chosen, categorical(filled, chosen))
    train, test = settled(encoded(train, cols)), settled(encoded(test, cols))
    return ChurnData(chosen, slots, train.unionByName(test), with_weights(train), test)


def train_models(data: ChurnData, trees: int = 100, rounds: int = 100) -> ChurnModels:
    """Random forest and boosted trees."""
    forest = RandomForestClassifier(
        labelCol="is_churned", weightCol="weight", numTrees=trees, maxDepth=10,
        minInstancesPerNode=25, featureSubsetStrategy="sqrt", seed=SEED, cacheNodeIds=True)
    boosted = GBTClassifier(
        labelCol="is_churned", weightCol="weight", maxIter=rounds, maxDepth=6, stepSize=0.1,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED, cacheNodeIds=True)
    train = data.train.persist()
    try:
        models = {"Random Forest": forest.fit(train), "Boosted Trees": boosted.fit(train)}
    finally:
        train.unpersist()
    return ChurnModels(**vars(data), models=models)


def class_balance(df: DataFrame) -> DataFrame:
    """Customers per label. Two rows."""
    g = df.groupBy("is_churned").agg(F.count(F.lit(1)).alias("customers"))
    return g.withColumn("pct", rnd(F.col("customers") * 100.0 / F.sum("customers").over(Window.partitionBy())))


def recency_crosstab(df: DataFrame) -> DataFrame:
    """Share of each label per recency bin: shows that recency decides the label."""
    edges = (30, 60, 90, 120, 150, 180, 365, HORIZON_DAYS)
    lows = (0, *edges)
    steps = [(high, f"({low}, {high}]") for low, high in zip(lows, edges)]
    binned = df.where(F.col("recency").between(1, HORIZON_DAYS)).select(
        bins("recency", steps, "").alias("recency_bin"), "is_churned")
    g = binned.groupBy("recency_bin").pivot("is_churned", [0, 1]).agg(F.count(F.lit(1)))
    kept, lost = (F.coalesce(str(k), F.lit(0)) for k in (0, 1))
    return g.select("recency_bin", rnd(ratio(kept, kept + lost), 3).alias("share_kept"),
                    rnd(ratio(lost, kept + lost), 3).alias("share_lost"))


def split_summary(m: ChurnData) -> DataFrame:
    def part(df, name):
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("customers"),
                      rnd(F.avg("is_churned"), 4).alias("churn_rate"))

    return part(m.train, "train").unionByName(part(m.test, "test"))


def confusion(m: ChurnModels, name: str) -> DataFrame:
    return m.predicted(name).groupBy("is_churned", F.col("prediction").cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("customers"))


def model_results(m: ChurnModels) -> DataFrame:
    """Accuracy, AUC, precision, recall and F1 on the test part, with the acceptance checks."""
    y, p = F.col("is_churned"), F.col("prediction")
    out = None
    for name in m.models:
        scored = m.predicted(name)
        right, found = F.count_if(y == p), F.count_if((y == 1) & (p == 1))
        precision, recall = ratio(found, F.count_if(p == 1)), ratio(found, F.count_if(y == 1))
        row = scored.agg(
            F.lit(name).alias("model"), rnd(ratio(right, F.count(F.lit(1))), 3).alias("accuracy"),
            F.lit(_rounded(exact_auc(scored), 3)).cast("double").alias("roc_auc"), rnd(precision, 3).alias("precision"),
            rnd(recall, 3).alias("recall"),
            rnd(ratio(precision * recall * 2, precision + recall), 3).alias("f1_score"))
        out = row if out is None else out.unionByName(row)
    # At most one row per model.
    best = F.max("roc_auc").over(Window.partitionBy())
    return out.withColumns({
        "is_best": F.col("roc_auc") == best,
        "auc_check": F.when(F.col("roc_auc") > 0.75, "PASS").otherwise("FAIL"),
        "precision_check": F.when(F.col("precision") > 0.60, "PASS").otherwise("FAIL"),
        "recall_check": F.when(F.col("recall") > 0.70, "PASS").otherwise("FAIL")})


def best_model(m: ChurnModels) -> str:
    return model_results(m).orderBy(F.desc("roc_auc"), "model").first()["model"]


def importance_table(m: ChurnModels, name: str) -> DataFrame:
    """The importance of every slot of the model's input (one row a slot, as many as the model has)."""
    weights = m.models[name].featureImportances.toArray()
    return m.prepared.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(m.slots, weights)], "feature string, importance double")


def feature_importance(m: ChurnModels, name: str, k: int = 15) -> DataFrame:
    """The report of the ``k`` most important slots."""
    return importance_table(m, name).orderBy(F.desc("importance"), "feature").limit(k)


def roc_points(scored: DataFrame, score: str = "churn_probability", label: str = "is_churned") -> DataFrame:
    """One ROC and precision-recall point per distinct score (ties are one step), from the highest
    score down: rows at or above the threshold count as predicted churn. ``area`` is the point's
    trapezoid under the ROC curve, so the sum of ``area`` is the exact AUC.

    Running counts come from the value profile (range partitions and their offsets), so no task
    holds all scores; the counts of the point itself come from a per-score aggregate joined on the
    score. A label without rows gives null rates.
    """
    rows = scored.select(score, F.col(label).cast("long").alias("_y"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
    positives, negatives = totals.pos or 0, totals.n - (totals.pos or 0)
    per_score = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p"))
    running = value_profile(rows, score, sums=["_y"], descending=True).join(per_score, score)
    tp, fp = F.col("cum__y"), F.col("cum_n") - F.col("cum__y")
    here_fp = F.col("_n") - F.col("_p")
    neg, pos = F.lit(float(negatives) or None), F.lit(float(positives) or None)
    return running.select(
        F.col(score).alias("threshold"),
        rnd(fp / neg, 6).alias("false_positive_rate"),
        rnd(tp / pos, 6).alias("true_positive_rate"),
        rnd(tp / F.col("cum_n"), 6).alias("precision"),
        (here_fp / neg * (tp * 2 - F.col("_p")) / (pos * 2)).alias("area"),
    )


def exact_auc(scored: DataFrame, score: str = "churn_probability", label: str = "is_churned") -> float | None:
    """Area under the ROC curve by trapezoids over all distinct scores."""
    return roc_points(scored, score, label).agg(F.sum("area")).first()[0]


def _rounded(v: float | None, digits: int) -> float | None:
    return None if v is None else round(v, digits)


def curve_points(m: ChurnModels, name: str) -> DataFrame:
    """ROC and precision-recall points of the model's test scores, one per distinct score."""
    return roc_points(m.predicted(name)).drop("area")


def scores(m: ChurnModels, name: str) -> DataFrame:
    """Churn probability and risk level of every customer."""
    return m.predicted(name, m.prepared).select(
        "customer_id", "customer_state", "total_revenue", "churn_probability",
        bins("churn_probability", [(0.3, "Low Risk"), (0.7, "Medium Risk")], "High Risk").alias("risk_level"))
