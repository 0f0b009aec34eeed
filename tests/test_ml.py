import datetime as dt

import pytest
from pyspark.sql import functions as F

from martloom.ml import churn, clusters


@pytest.fixture(scope="module")
def people(layers):
    return churn.churn_features(churn.churn_customers(layers.mart("customer_ltv"), dt.date(2001, 8, 2), None)).cache()


@pytest.fixture(scope="module")
def models(people):
    return churn.train_models(churn.training_data(people), trees=5, rounds=3)


def test_label_is_a_recency_threshold(people):
    assert people.where((F.col("recency") > 180) != (F.col("is_churned") == 1)).count() == 0


def test_single_purchase_population(layers):
    one = churn.churn_customers(layers.mart("customer_ltv"), dt.date(2001, 8, 2))
    assert one.where("total_orders > 1").count() == 0


def test_selection_drops_one_of_each_correlated_pair(people):
    kept = churn.select_features(people)
    assert "purchase_season" in kept
    assert not {"value_per_day", "value_time_ratio"} <= set(kept)  # equal columns
    assert not {"recency", "time_churn_prob"} <= set(kept)  # one is a multiple of the other
    assert not {"total_revenue", "revenue_zscore"} <= set(kept) and "revenue_zscore" not in kept


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (5.0, None)], "recency double, customer_state string")
    got = churn.imputed(df, ("recency", "customer_state")).collect()
    assert [r.recency for r in got] == [1.0, 3.0, 3.0, 5.0] and got[3].customer_state == "b"


def test_split_is_stable_and_complete(people):
    a, b = churn.split(people)
    again, _ = churn.split(people.repartition(7))
    assert a.count() + b.count() == people.count() and b.count() > 0
    assert {r[0] for r in a.select("customer_id").collect()} == {r[0] for r in again.select("customer_id").collect()}


def test_weights_balance_the_labels(people):
    sums = churn.with_weights(people).groupBy("is_churned").agg(F.sum("weight").alias("w")).collect()
    assert sums[0].w == pytest.approx(sums[1].w)


def test_no_leaking_feature_is_trained_on(models, people):
    assert not set(models.features) & set(churn.leaking_columns(people))
    assert "value_per_day" not in models.features
    assert len(models.slots) == models.prepared.first().features.size


def test_lineage_finds_everything_made_from_recency(people):
    leaking = set(churn.leaking_columns(people))
    assert {"recency", "recency_log", "recency_sqrt", "recency_binned", "time_churn_prob", "value_per_day",
            "value_time_ratio", "recency_value_interaction", "recency_zscore"} <= leaking
    assert not leaking & {"total_revenue", "revenue_log", "purchase_month", "customer_state", "is_high_value",
                          "tenure_days", "is_churned"}


def test_no_kept_feature_moves_with_recency(layers, models):
    def at(day):
        people = churn.churn_customers(layers.mart("customer_ltv"), day, None)
        return churn.churn_features(people).select("customer_id", *models.features)

    now, later = at(dt.date(2001, 8, 2)), at(dt.date(2001, 9, 1))
    assert now.count() == later.count() > 0
    assert now.exceptAll(later).count() == 0


def test_results_agree_with_the_confusion_matrix(models):
    name = churn.best_model(models)
    row = churn.model_results(models).where(F.col("model") == name).first()
    cells = {(r.is_churned, r.prediction): r.customers for r in churn.confusion(models, name).collect()}
    right = cells.get((0, 0), 0) + cells.get((1, 1), 0)
    assert row.accuracy == pytest.approx(right / sum(cells.values()), abs=1e-3)
    assert sum(cells.values()) == models.test.count()


def test_curve_is_monotone(models):
    pts = churn.curve_points(models, "Random Forest").orderBy(F.desc("threshold")).collect()
    assert [p.true_positive_rate for p in pts] == sorted(p.true_positive_rate for p in pts)
    assert pts[-1].true_positive_rate == 1.0 and pts[-1].false_positive_rate == 1.0


def test_every_customer_is_scored(models, people):
    s = churn.scores(models, "Random Forest")
    assert s.count() == people.count() and s.where("churn_probability not between 0 and 1").count() == 0


def test_clusters(layers):
    vectors = clusters.cluster_input(layers.mart("customer_base"), layers.mart("customer_rfm"), layers.mart("customer_ltv"))
    profile = clusters.profiles(clusters.fit(vectors, 3).transform(vectors))
    assert profile.agg(F.sum("num_customers")).first()[0] == vectors.count()
    for r in clusters.priorities(profile).collect():
        assert r.priority_score == r.value_score * r.loyalty_score


def test_cluster_recommendations(spark):
    named = spark.createDataFrame([("At Risk",), ("At Risk",), ("Regular",)], "cluster_name string")
    assert clusters.recommendations(named).count() == 8  # both names have four actions


def test_stratified_split_has_an_exact_quota_per_label(spark):
    import hashlib

    from martloom.ml.churn import split_parts

    rows = [(i, int(i % 7 == 0)) for i in range(1, 1234)] + [(5000, 1), (5001, 1)]
    got = {r.customer_id: r.part for r in split_parts(spark.createDataFrame(rows, "customer_id long, is_churned int")).collect()}
    for label in (0, 1):
        ids = [i for i, y in rows if y == label]
        quota = (2 * len(ids) + 5) // 10
        assert abs(quota - len(ids) / 5) <= 0.5
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        assert {i for i in ids if got[i] == "test"} == set(ranked[:quota])
    assert len(got) == len(rows)


def test_roc_points_equal_sql_and_auc_equals_pair_counting(spark):
    import random

    import duckdb

    rnd_ = random.Random(4)
    rows = [(i, round(rnd_.random(), 2), int(rnd_.random() < 0.4)) for i in range(400)]
    rows += [(1000 + i, 0.5, i % 2) for i in range(20)]  # a tie across labels
    scored = spark.createDataFrame(rows, "customer_id long, churn_probability double, is_churned int")
    got = sorted(tuple(r) for r in churn.roc_points(scored).drop("area").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE s (customer_id BIGINT, churn_probability DOUBLE, is_churned INTEGER)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    con.execute("CREATE MACRO r(x) AS CAST(ROUND(CAST(x AS DECIMAL(28, 8)), 6) AS DOUBLE)")
    want = con.sql("""
        WITH t AS (SELECT churn_probability AS th, count(*) AS n, sum(is_churned) AS p FROM s GROUP BY 1),
        c AS (SELECT th, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM t
              WINDOW w AS (ORDER BY th DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        tot AS (SELECT count(*) AS n, sum(is_churned) AS p FROM s)
        SELECT th, r((cn - cp) / (tot.n - tot.p)), r(cp / tot.p), r(cp / cn) FROM c, tot
    """).fetchall()
    assert got == sorted(tuple(float(x) for x in r) for r in want)
    pos = [p for _, p, y in rows if y == 1]
    neg = [p for _, p, y in rows if y == 0]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert churn.exact_auc(scored) == pytest.approx(pairs, abs=1e-12)
    assert churn.exact_auc(scored.where("is_churned = 0")) is None


def test_kmeans_is_deterministic_and_its_assignment_is_stated_in_sql(spark):
    import random

    import duckdb
    from pyspark.ml.feature import VectorAssembler

    rnd_ = random.Random(7)
    rows = [(i, cx + rnd_.gauss(0, 0.3), cy + rnd_.gauss(0, 0.3))
            for i, (cx, cy) in enumerate([(0, 0), (5, 5), (-4, 6)] * 40)]
    rows += [(500, 9.0, 9.0), (501, 9.0, 9.0)]  # a tie for the farthest point: the smaller id is the seed
    df = spark.createDataFrame(rows, "customer_id long, x double, y double")
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    a, centres = clusters.kmeans_assign(vectors, k=4)
    b, again = clusters.kmeans_assign(vectors.repartition(5), k=4)
    assert centres == again
    got = {r.customer_id: r.cluster for r in a.collect()}
    assert got == {r.customer_id: r.cluster for r in b.collect()}
    assert len(set(got.values())) == 4
    con = duckdb.connect()
    con.execute("CREATE TABLE p (customer_id BIGINT, x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE c (i INTEGER, cx DOUBLE, cy DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", [(i, c[0], c[1]) for i, c in enumerate(centres)])
    want = dict(con.sql("""SELECT customer_id, arg_min(i, ((x - cx) * (x - cx) + (y - cy) * (y - cy), i))
                           FROM p, c GROUP BY customer_id""").fetchall())
    assert got == want
    assert clusters.farthest_first(a.withColumn("v", F.array("x", "y")), 1) == [[9.0, 9.0]]


def test_every_cluster_name_has_recommendations(spark):
    names = ["High Value Loyal", "High Value One-Time", "Regular", "At Risk"]
    profile = spark.createDataFrame([(n,) for n in names], "cluster_name string")
    got = clusters.recommendations(profile).groupBy("cluster_name").count().collect()
    assert {r.cluster_name: r["count"] for r in got} == {n: 4 for n in names}


def test_correlations_of_pairs_in_a_narrow_aggregate(spark, monkeypatch):
    rows = [(1.0, 2, 5.0, 3.0), (2.0, 4, None, 3.0), (4.0, 9, 1.0, 3.0), (None, 1, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    widths = []
    plain = churn.pearson
    monkeypatch.setattr(churn, "pearson", lambda x, y: widths.append(1) or plain(x, y))
    found = churn.correlations(df, ["a", "b", "c", "d"])
    assert widths == [1]
    want = df.agg(*[plain(x, y).alias(f"{x}{y}") for x, y in found]).first()
    assert len(found) == 6 and found["d", "a"] is None
    for x, y in found:
        assert found[x, y] == (want[f"{x}{y}"] and pytest.approx(want[f"{x}{y}"], abs=1e-12))
    empty = churn.correlations(df.limit(0), ["a", "b"])
    assert empty == {("b", "a"): None}
