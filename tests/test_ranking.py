import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martloom.operators.ranking import (
    global_position, grouped_quantile, quantiles, value_profile, with_group_quantile, with_ntile,
)
from martloom.operators.sequence import (
    keep_first, most_frequent, sequence_within, top_per_group,
)

DISTINCT = 40


def data(n, distinct=DISTINCT):
    rng = random.Random(n)
    return [(i, rng.randrange(distinct), rng.randrange(1000)) for i in range(n)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "id long, v long, w long").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 500])
@pytest.mark.parametrize("distinct", [1, DISTINCT])
def test_ntile_matches_the_window(spark, n, distinct):
    df = frame(spark, data(n, distinct))
    order = [F.col("v").desc(), F.col("id")]
    got = {r.id: r.t for r in with_ntile(df, order, 5, "t").collect()}
    want = {r.id: r.t for r in df.withColumn("t", F.ntile(5).over(Window.orderBy(*order))).collect()}
    assert got == want


def test_positions_match_the_window(spark):
    df = frame(spark, data(777), parts=7)
    order = [F.col("v"), F.col("id")]
    got = {r.id: (r.position, r.total_rows) for r in global_position(df, order).collect()}
    want = {r.id: (r.p, 777) for r in df.withColumn("p", F.row_number().over(Window.orderBy(*order))).collect()}
    assert got == want


@pytest.mark.parametrize("descending", [False, True])
def test_value_profile_matches_the_windows(spark, descending):
    df = frame(spark, data(600))
    w = Window.orderBy(F.desc("v") if descending else F.asc("v"))
    want = {(r.v, r.c, r.s, r.d) for r in df.select(
        "v", F.count("*").over(w).alias("c"), F.sum("w").over(w).alias("s"),
        F.dense_rank().over(w).alias("d")).collect()}
    got = {(r.v, r.cum_n, r.cum_w, r.dense_rank)
           for r in value_profile(df, "v", sums=["w"], descending=descending).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 5, 501])
def test_quantiles_match_the_exact_aggregate(spark, n):
    df = frame(spark, data(n))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = list(quantiles(df, "v", probs).first())
    want = df.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).first().q
    assert got == pytest.approx(want, abs=1e-6)


def test_quantiles_of_nothing_are_null(spark):
    assert list(quantiles(frame(spark, []), "v", [0.5]).first()) == [None]


@pytest.fixture
def split_ranges(spark):
    """Keeps small range partitions apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("hot_keys", [1, 3])
def test_sequence_is_the_window_for_hot_keys(spark, hot_keys, split_ranges):
    """A few keys hold most rows and go over several partitions."""
    rng = random.Random(3)
    rows = [(i, -rng.randrange(hot_keys) if rng.random() < 0.6 else rng.randrange(1, 30), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows + [(1000, None, 1), (1001, None, 2)], "id long, k long, t long")
    got = {(r.id, r.seq, r.previous_t) for r in sequence_within(df, "k", ["t", "id"], "t").collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(r.id, r.s, r.p) for r in df.select(
        "id", F.row_number().over(w).alias("s"), F.lag("t").over(w).alias("p")).collect()}
    assert got == want


def test_sequence_of_many_hot_keys_and_of_nothing(spark, split_ranges):
    df = spark.range(3000).selectExpr("id", "id % 300 as k", "-id as t")
    rows = sequence_within(df, "k", ["t", "id"], "t")
    wrong = rows.where("seq <> 10 - id div 300 or previous_t is distinct from if(seq = 1, null, t - 300)")
    assert rows.count() == 3000 and wrong.count() == 0
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k#" not in plan
    assert sequence_within(df.where("id < 0"), "k", ["t", "id"], "t").count() == 0


def test_keep_first_orders_nulls_first_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, 3, "a"), (2, 5, "y"), (2, 5, "x")], "k int, t int, s string")
    got = {(r.k, r.t, r.s) for r in keep_first(df, ["k"], [F.col("t").asc_nulls_first(), "s"]).collect()}
    assert got == {(1, None, "b"), (2, 5, "x")}


def test_mode_ignores_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (1, None), (2, None), (3, "c"), (3, "c"), (3, "z")],
                               "k int, v string")
    assert {(r.k, r.m) for r in most_frequent(df, "k", "v", "m").collect()} == {(1, "b"), (3, "c")}


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = frame(spark, data(200))
    out = top_per_group(df, ["v"], [F.desc("w"), "id"], 2)
    assert out.groupBy("v").count().agg(F.max("count")).first()[0] == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_grouped_quantile_equals_percentile_disc(spark):
    import duckdb

    rows = [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", None), (None, 7), (None, 8), (None, 9),
            ("c", 2), ("c", 2), ("c", 1), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR, v BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = sorted(map(tuple, grouped_quantile(df, ["k"], "v", q).collect()), key=repr)
        want = con.sql(f"SELECT k, quantile_disc(v, {q}) FROM t WHERE v IS NOT NULL GROUP BY k").fetchall()
        assert got == sorted(want, key=repr)
    assert grouped_quantile(df.where("v < 0"), ["k"], "v").count() == 0


def test_grouped_median_of_a_group_over_a_million_values(spark):
    import duckdb

    n = 1_100_000
    big = spark.range(n + 7000).select(
        F.when(F.col("id") < n, 0).otherwise(F.col("id") % 7).alias("k"),
        ((F.col("id") * 7919) % 1_000_003).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(map(tuple, grouped_quantile(big, ["k"], "v").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = big.toPandas()
    assert got == sorted(duckdb.sql("SELECT k, quantile_disc(v, 0.5) FROM pdf GROUP BY k").fetchall())


def test_with_group_quantile_fills_the_placeholder(spark):
    df = spark.createDataFrame([("a", 1.005), ("a", 3.0), ("b", None), (None, 2.0)], "k string, v double")
    summary = df.groupBy("k").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("med"))
    got = {(r.k, r.n, r.med) for r in with_group_quantile(summary, df, ["k"], "v", "med", digits=2).collect()}
    assert got == {("a", 2, 1.01), ("b", 1, None), (None, 1, 2.0)}
    whole = df.agg(F.lit(None).cast("double").alias("med"), F.count("*").alias("n"))
    assert [tuple(r) for r in with_group_quantile(whole, df, [], "v", "med").collect()] == [(2.0, 4)]
