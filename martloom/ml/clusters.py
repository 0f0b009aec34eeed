"""Customer clusters: k-means on scaled behaviour, profiles, priorities, recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import money_sum, ratio, rnd
from martloom.operators.ranking import with_group_quantile
from martloom.functions.fixed import CLUSTER_RECOMMENDATIONS
from martloom.operators.storage import settled

FEATURES = ("total_revenue", "total_orders", "avg_order_value", "recency", "frequency", "monetary",
            "customer_lifespan_days", "orders_per_month", "avg_review_score")
SEED = 42


@dataclass(frozen=True)
class ClusterNaming:
    """A cluster is valuable at ``value_factor`` times the mean customer, loyal at a repeat rate."""

    value_factor: float = 2.0
    loyal_rate: float = 0.5


def cluster_input(base: DataFrame, rfm: DataFrame, ltv: DataFrame) -> DataFrame:
    """One scaled vector per customer."""
    joined = (
        base.select("customer_id", "total_revenue", "total_orders", "avg_order_value",
                    "customer_lifespan_days", "avg_review_score",
                    F.col("is_repeat_customer").cast("int").alias("is_repeat_customer"))
        .join(rfm.select("customer_id", "recency", "frequency", "monetary"), "customer_id")
        .join(ltv.select("customer_id", "orders_per_month"), "customer_id", "left")
        .fillna(0.0)
    )
    raw = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(joined)
    return settled(
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
        .fit(raw).transform(raw).drop("raw"))


def fit(vectors: DataFrame, k: int = 5):
    return KMeans(k=k, seed=SEED, maxIter=50, featuresCol="features", predictionCol="cluster").fit(vectors)


def _distance(point: Column, centre: list[float]) -> Column:
    """Squared Euclidean distance of an array column to a fixed centre."""
    return F.aggregate(F.zip_with(point, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda acc, x: acc + x)


def _nearest(point: Column, centres: list[list[float]]) -> Column:
    """Index of the nearest centre; ties go to the lower index."""
    ranked = F.array(*[F.struct(_distance(point, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(ranked)["i"]


def farthest_first(points: DataFrame, k: int) -> list[list[float]]:
    """k seeds: the point farthest from the origin of the scaled space, then again and again the
    point farthest from its nearest seed; ties go to the smallest customer_id. One aggregate pass
    per seed, and only the seeds reach the driver."""
    seeds: list[list[float]] = []
    for _ in range(k):
        near = [_distance(F.col("v"), c) for c in seeds] or [_distance(F.col("v"), [0.0] * len(points.first()["v"]))]
        gap = F.least(*near) if len(near) > 1 else near[0]
        best = points.agg(F.max_by("v", F.struct(gap, -F.col("customer_id"))).alias("v")).first()
        if best is None or best.v is None or list(best.v) in seeds:
            break
        seeds.append(list(best.v))
    return seeds


def kmeans_assign(vectors: DataFrame, k: int = 5, max_iter: int = 50) -> tuple[DataFrame, list[list[float]]]:
    """``(vectors with cluster, centres)``: Lloyd steps from farthest-first seeds, in DataFrame
    expressions, until no centre moves or ``max_iter`` steps; a centre without points stays. The
    result does not depend on partitioning or on a random start."""
    points = settled(vectors.withColumn("v", vector_to_array("features")))
    if points.limit(1).count() == 0:
        return points.withColumn("cluster", F.lit(None).cast("int")).drop("v"), []
    centres = farthest_first(points.select("customer_id", "v"), k)
    width = len(centres[0])
    for _ in range(max_iter):
        means = points.select(_nearest(F.col("v"), centres).alias("c"), "v").groupBy("c").agg(
            # Exact decimal sums: the centres do not depend on how partitions are merged.
            *[F.avg(F.col("v")[j].cast("decimal(30,18)")).cast("double").alias(f"m{j}") for j in range(width)]
        ).collect()
        moved = [list(c) for c in centres]
        for r in means:
            moved[r.c] = [r[f"m{j}"] for j in range(width)]
        if moved == centres:
            break
        centres = moved
    return points.withColumn("cluster", _nearest(F.col("v"), centres)).drop("v"), centres


def elbow(vectors: DataFrame, ks: range = range(2, 9)) -> DataFrame:
    """Within-cluster cost and silhouette for several k."""
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows = []
    for k in ks:
        model = fit(vectors, k)
        rows.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(vectors)))))
    return vectors.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def profiles(clustered: DataFrame, naming: ClusterNaming = ClusterNaming()) -> DataFrame:
    """Size, means, medians and name of each cluster."""
    means = [c for c in FEATURES if c != "total_revenue"]
    typical = clustered.agg(F.avg("total_revenue").alias("v")).scalar()
    g = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("num_customers"),
        rnd(ratio(money_sum("total_revenue"), F.count(F.lit(1)))).alias("total_revenue_mean"),
        F.lit(None).cast("double").alias("total_revenue_median"),
        rnd(money_sum("total_revenue")).alias("total_revenue_sum"),
        *[rnd(F.avg(c)).alias(f"{c}_mean") for c in means],
        F.lit(None).cast(clustered.schema["total_orders"].dataType).alias("total_orders_median"),
        rnd(F.avg("is_repeat_customer"), 4).alias("is_repeat_customer_mean"),
    )
    g = with_group_quantile(g, clustered, ["cluster"], "total_revenue", "total_revenue_median", digits=2)
    g = with_group_quantile(g, clustered, ["cluster"], "total_orders", "total_orders_median")
    valuable = F.col("total_revenue_mean") >= typical * naming.value_factor
    loyal = F.col("is_repeat_customer_mean") >= naming.loyal_rate
    return g.withColumn("cluster_name", cluster_name(valuable, loyal))


def cluster_name(valuable: Column, loyal: Column) -> Column:
    return (F.when(valuable & loyal, "High Value Loyal").when(valuable, "High Value One-Time")
            .when(loyal, "Regular").otherwise("At Risk"))


def priorities(profile: DataFrame) -> DataFrame:
    """Value score times loyalty score, highest first."""
    value = F.when(F.col("cluster_name").startswith("High Value"), 3).otherwise(1)
    loyalty = F.when(F.col("cluster_name").isin("High Value Loyal", "Regular"), 3).otherwise(1)
    return profile.select(
        "cluster", F.col("cluster_name").alias("name"), "num_customers",
        F.col("total_revenue_sum").alias("total_revenue"), value.alias("value_score"),
        loyalty.alias("loyalty_score"), (value * loyalty).alias("priority_score")
    ).orderBy(F.desc("priority_score"), F.desc("total_revenue"))


def recommendations(profile: DataFrame) -> DataFrame:
    """One row per cluster name and recommended action; every cluster name has actions."""
    table = F.create_map(*[e for k, v in CLUSTER_RECOMMENDATIONS.items()
                           for e in (F.lit(k), F.array(*map(F.lit, v)))])
    return profile.select("cluster_name").distinct().select(
        "cluster_name", F.explode(F.try_element_at(table, F.col("cluster_name"))).alias("recommendation"))
