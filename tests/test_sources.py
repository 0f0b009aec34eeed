import pytest
from pyspark.sql import functions as F

from martloom.operators.quality import fk_check, iqr_outliers, key_check, null_profile
from martloom.sources.raw import export_csv, extract, metric_rows, raw_schema, read_csv, read_parquet, save_table


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,'
                    'review_creation_date,review_answer_timestamp\n'
                    'r1,o1,5,,"two\nlines, ""quoted""",2018-01-01 00:00:00,2018-01-02 10:11:12\n')
    row = read_csv(spark, str(path), "reviews").first()
    assert row.review_comment_message == 'two\nlines, "quoted"' and row.review_score == 5
    assert row.review_answer_timestamp.hour == 10 and row.review_comment_title is None


def test_parquet_must_have_the_model_columns(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    df = spark.createDataFrame([("s", 1, "c", "SP", 9)], raw_schema("sellers").add("extra", "integer"))
    df.write.parquet(good)
    df.drop("seller_city").write.parquet(bad)
    assert read_parquet(spark, good, "sellers").columns == raw_schema("sellers").names
    with pytest.raises(ValueError, match="seller_city"):
        read_parquet(spark, bad, "sellers")


def test_save_replaces_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert save_table(spark.range(5), path).count() == 5
    assert save_table(spark.range(3), path).count() == 3


def test_extract_filters_orders_and_cuts(spark):
    got = extract(spark.range(10), "id > 2", [F.desc("id")], 2).collect()
    assert [r.id for r in got] == [9, 8]


def test_export_writes_a_header_and_flat_arrays(spark, tmp_path):
    path = str(tmp_path / "out")
    export_csv(spark.range(1).select("id", F.array(F.lit("a"), F.lit("b")).alias("kinds")), path)
    row = spark.read.option("header", True).csv(path).first()
    assert (row.id, row.kinds) == ("0", "a|b")


def test_metric_rows(spark):
    df = spark.range(4).agg(F.count("*").alias("Rows"), F.avg("id").alias("Mean"))
    assert {(r.metric, r.value) for r in metric_rows(df).collect()} == {("Rows", 4.0), ("Mean", 1.5)}


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 3), (4, 4)], "k int, v int")
    nulls = null_profile(df, "t").first()
    assert (nulls.total_rows, nulls.pct_null_k, nulls.pct_null_v) == (4, 25.0, 25.0)
    keys = key_check(df, ["k"], "t").first()
    assert (keys.total_rows, keys.distinct_keys, keys.duplicated_keys, keys.null_key_rows) == (4, 3, 1, 1)
    orphans = fk_check(df, spark.createDataFrame([(1,)], "k int"), "k", "r").first()
    assert (orphans.child_rows, orphans.orphan_rows) == (4, 2)


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "v double")
    r = iqr_outliers(df, "v").first()
    assert (r.q1, r.q3, r.outliers) == (2.25, 4.75, 1)


def test_checked_csv_sets_every_fault_apart(spark, tmp_path):
    from martloom.sources.raw import read_csv_checked

    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"two\nlines, ""quoted""",2018-01-02 10:00:00,2018-01-03 10:00:00\n'
        "r2,o2,five,,,2018-01-02 10:00:00,2018-01-03 10:00:00\n"
        ",o3,4,,,2018-01-02 10:00:00,2018-01-03 10:00:00\n"
        "r4,o4,3\n"
        "r5,o5,3,,,2018-01-02 10:00:00,2018-01-03 10:00:00,extra\n"
        "r6,o6,2,,,yesterday,2018-01-03 10:00:00\n"
    )
    rows, rejects = read_csv_checked(spark, str(path), "reviews")
    (good,) = rows.collect()
    assert (good.review_id, good.review_score, good.review_comment_message) == ("r1", 5, 'two\nlines, "quoted"')
    got = {r.key: r.reason for r in rejects.collect()}
    assert got == {"r2": "review_score: not int: five", None: "review_id: missing", "r4": "fields: not 7",
                   "r5": "fields: not 7", "r6": "review_creation_date: not timestamp_ntz: yesterday"}
    assert all(r.file.endswith("reviews.csv") and r.record for r in rejects.collect())


def test_shared_folder_is_qualified(spark):
    from martloom.operators.storage import shared_dir

    folder = shared_dir(spark)
    assert folder.startswith("file:") or "://" in folder
