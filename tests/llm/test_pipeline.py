import corpus_pipeline

BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    assert kept(spark, [(1, BASE, "a"), (1, BASE, "a"), (1, BASE, "a")]) == [(1, BASE, "a")]
    assert kept(spark, [(None, BASE, "a"), (None, BASE + " x", "a"), (None, OTHER, "b")]) in (
        sorted([(None, BASE, "a"), (None, OTHER, "b")], key=str), sorted([(None, BASE + " x", "a"), (None, OTHER, "b")], key=str))
    assert kept(spark, [(None, BASE, "a"), (7, BASE + " x", "a"), (9, BASE, "a")]) == [(7, BASE + " x", "a")]
    assert kept(spark, [(9, BASE, "a"), (5, BASE + " x", "a"), (3, BASE, "a"), (9, OTHER, "b"), (4, None, "c")]) == sorted(
        [(3, BASE, "a"), (9, OTHER, "b"), (4, None, "c")], key=str)
    assert kept(spark, []) == []
